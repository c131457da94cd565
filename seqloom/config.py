"""Options of the jobs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from .operators.em import Options


@dataclass(frozen=True)
class Config:
    """``labels`` sequences are drawn for each of ``folds`` folds; ``fold`` is the training one."""

    data_path: str = ""
    graph_path: str = ""
    ngram_path: str = ""
    umap_path: str = ""
    suffix_path: str = ""
    language: str = "english"
    encoding: str = "UTF-8"
    order: int = 2
    # graph
    ngram_size: int = 3
    context_size: int = 5
    neighbors: int = 60
    mutual: bool = True
    min_similarity: float = 0.0
    # samples
    labels: int = 100
    folds: int = 10
    fold: int = 0
    seed: int = 12345
    seed_folder: int = 0
    scale_features: bool = False
    backoff: float = 1e-8
    prune: bool = True
    max_letters: int = 0
    # training
    label_strength: float = 1.0
    graph_strength: float = 1.0
    gaussian_prior: float = 100.0
    em_iterations: int = 1
    e_iterations: int = 50
    m_iterations: int = 50
    em_stop: float = 0.01
    e_stop: float = 0.01
    m_stop: float = 1e-5
    eta: float = 0.2

    def options(self) -> Options:
        return Options(self.label_strength, self.graph_strength, self.gaussian_prior, self.em_iterations, self.e_iterations, self.m_iterations, self.em_stop, self.e_stop, self.m_stop, self.eta)
