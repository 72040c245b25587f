"""Settings of record linkage. Names and defaults are part of the interface."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass

# Replacements of words in names, in the order in which they apply.
REPLACEMENTS = {
    "traiier": "trailer", "rpr": "repair", "svcs": "service", "svc": "service", "ctr": "center", "ctrs": "centers",
    "cntr": "center", "trk": "truck", "auto": "automotive", "auth": "authorized", "dist": "distribution",
    "mfg": "manufacturing", "mfr": "manufacturing", "equip": "equipment", "natl": "national", "mgmt": "management",
    "assoc": "associates",
}
# Legal forms and the like that names lose.
SUFFIXES = (
    "inc", "incorporated", "llc", "ll", "lp", "llp", "ltd", "limited", "corp", "corporation", "co", "company", "plc",
    "pllc", "pa", "pc", "sc", "dba", "fka", "aka", "etal", "et al", "international", "intl", "usa", "america", "us",
    "group", "grp", "holdings", "ent",
)


@dataclass(frozen=True)
class Columns:
    entity_col: str = "company_name"
    address_cols: tuple[str, ...] = ("address",)


@dataclass(frozen=True)
class Normalization:
    replacements: dict = field(default_factory=lambda: dict(REPLACEMENTS))
    suffixes_to_remove: tuple[str, ...] = SUFFIXES


@dataclass(frozen=True)
class Modeling:
    encoders: tuple[str, ...] = ("tfidf", "phonetic", "semantic")
    sparse_reducers: tuple[str, ...] = ("svd", "pca")
    use_address_in_encoding: bool = True
    feature_variance_threshold: float = 0.001
    semantic_batch_size: int = 512
    epsilon: float = 1e-8
    cosine_consensus_n_samples: int = 8192
    cosine_consensus_batch_size: int = 2048
    semantic_model: str = "all-mpnet-base-v2"
    profile_comparison_max_pairs_per_chunk: int = 1_000_000
    hdbscan_params: dict = field(default_factory=lambda: {"min_cluster_size": 3, "min_samples": 1, "cluster_selection_epsilon": 0.15, "prediction_data": True, "alpha": 0.8, "cluster_selection_method": "leaf", "allow_single_cluster": False})
    tfidf_params: dict = field(default_factory=lambda: {"analyzer": "char", "ngram_range": [3, 5], "max_features": 10000, "min_df": 3, "sublinear_tf": True})
    tfidf_svd_params: dict = field(default_factory=lambda: {"n_components": 2048, "maxiter": 20, "tol": 1e-5})
    tfidf_pca_params: dict = field(default_factory=lambda: {"n_components": 768, "svd_solver": "full", "tol": 1e-8, "iterated_power": 20})
    phonetic_max_words: int = 5
    phonetic_params: dict = field(default_factory=lambda: {"analyzer": "word", "binary": True, "max_features": 2000})
    phonetic_svd_params: dict = field(default_factory=lambda: {"n_components": 384, "maxiter": 20, "tol": 1e-5})
    phonetic_pca_params: dict = field(default_factory=lambda: {"n_components": 256, "svd_solver": "full", "tol": 1e-8, "iterated_power": 20})
    umap_n_runs: int = 3
    umap_params: dict = field(default_factory=lambda: {"n_neighbors": 15, "n_components": 48, "min_dist": 0.05, "spread": 0.5, "metric": "cosine", "init": "spectral", "n_epochs": 400, "negative_sample_rate": 7, "repulsion_strength": 1.0, "learning_rate": 0.5})
    nearest_neighbors_params: dict = field(default_factory=lambda: {"n_neighbors": 20, "metric": "cosine"})
    similarity_tfidf: dict = field(default_factory=lambda: {"analyzer": "char", "ngram_range": [3, 5], "min_df": 2, "sublinear_tf": True, "norm": "l2"})
    stream_proportions: dict = field(default_factory=lambda: {"semantic": 0.45, "tfidf": 0.40, "phonetic": 0.15})
    snn_clustering_params: dict = field(default_factory=lambda: {"k_neighbors": 40, "louvain_resolution": 0.65})
    noise_attachment_params: dict = field(default_factory=lambda: {"k_neighbors": 15, "attachment_similarity_threshold": 0.82, "min_matching_neighbors": 2, "attachment_ratio_threshold": 1.5})
    cluster_merging_params: dict = field(default_factory=lambda: {"merge_median_threshold": 0.84, "merge_max_threshold": 0.90, "merge_sample_size": 20, "merge_batch_size": 1000, "centroid_similarity_threshold": 0.75, "centroid_sample_size": 1000})
    ensemble_params: dict = field(default_factory=lambda: {"purity_min": 0.75, "min_overlap": 2, "allow_new_snn_clusters": True, "min_newcluster_size": 4, "default_rescue_conf": 0.60})
    umap_param_ranges: dict = field(default_factory=lambda: {"n_neighbors": [5, 65], "min_dist": [0.0, 0.15], "spread": [0.3, 1.5], "n_epochs": [200, 500], "learning_rate": [0.3, 2.0], "repulsion_strength": [0.3, 1.5], "negative_sample_rate": [3, 30], "init_strategies": ["spectral", "random"]})


@dataclass(frozen=True)
class Validation:
    street_number_threshold: int = 50
    address_fuzz_ratio: float = 87
    name_fuzz_ratio: float = 89
    enforce_state_boundaries: bool = True
    allow_neighboring_states: tuple[tuple[str, str], ...] = ()
    validate_cluster_batch_size: int = 1000
    reassignment_scoring_weights: dict = field(default_factory=lambda: {"name_similarity": 0.40, "address_similarity": 0.40, "cluster_size": 0.10, "cluster_probability": 0.10})
    empty_state_is_null: bool = False


@dataclass(frozen=True)
class Scoring:
    weights: dict = field(default_factory=lambda: {"cluster_probability": 0.25, "name_similarity": 0.20, "address_confidence": 0.25, "cohesion_score": 0.15, "cluster_size_factor": 0.15})


@dataclass(frozen=True)
class Output:
    output_format: str = "proper"
    review_confidence_threshold: float = 0.75
    log_level: str = "INFO"
    split_address_components: bool = False


@dataclass(frozen=True)
class Config:
    columns: Columns = field(default_factory=Columns)
    normalization: Normalization = field(default_factory=Normalization)
    modeling: Modeling = field(default_factory=Modeling)
    validation: Validation = field(default_factory=Validation)
    scoring: Scoring = field(default_factory=Scoring)
    output: Output = field(default_factory=Output)
    random_state: int = 42

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return _build(cls, json.loads(text))


_SECTIONS = {"columns": Columns, "normalization": Normalization, "modeling": Modeling, "validation": Validation, "scoring": Scoring, "output": Output}


def _build(kind, values: dict):
    out = {}
    for f in fields(kind):
        v = values.get(f.name)
        if f.name in values:
            if f.name in _SECTIONS and is_dataclass(_SECTIONS[f.name]) and kind is Config:
                v = _build(_SECTIONS[f.name], v)
            elif isinstance(v, list):
                v = tuple(tuple(x) if isinstance(x, list) else x for x in v)
            out[f.name] = v
    return kind(**out)
