"""Settings with their defaults; a real zero is a zero."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConf:
    min_nonempty_pages: int = 5
    min_total_chars: int = 2000
    content_start_page: int = 1
    min_chunk_chars: int = 120
    max_chars: int = 900
    overlap_units: int = 1
    hard_cut_overlap: int = 150
    merge_min: int = 200
    k1: float = 1.5
    b: float = 0.75
    ngram_min: int = 2
    ngram_max: int = 6
    min_df: int = 2
    max_df_ratio: float = 0.20
    per_chunk_keep: int = 120
    max_postings: int = 2000
    keep_earliest: int = 200
    top_k: int = 16
    min_keep: int = 6
    score_delta: float = 0.20
    gap_threshold: float = 0.18
    min_score: float | None = None
    alpha: float | None = 0.65
    channel_k: int = 50
    rrf_k0: int = 60
    rerank_candidates: int = 32
    rerank_chars: int = 800
    extra_query_weight: float = 0.7
    entity_postings: int = 20
    entity_weight: float = 0.8
    chrono_weight: float = 0.35
    evidence_chunks: int = 10
    evidence_chunk_chars: int = 900
    evidence_chars: int = 10000
    retry_on_abstain: bool = True
    temporal_candidates: int = 80
    temporal_keep: int = 6


PREFIX = "spark.foliospark."


def configured(spark, environ: Mapping[str, str] | None = None) -> EngineConf:
    """Settings of a session: spark.foliospark.<name>, else FOLIOSPARK_<NAME> of the environment, else the default.

    none stands for no value where a setting may have none; what can't be read as its setting's type is an error that names it.
    """
    environ, found = os.environ if environ is None else environ, {}
    for f in fields(EngineConf):
        text = spark.conf.get(PREFIX + f.name, None) or environ.get(f"FOLIOSPARK_{f.name.upper()}")
        if text is None:
            continue
        kind, text = str(f.type), text.strip()
        try:
            if text.lower() == "none" and "None" in kind:
                found[f.name] = None
            elif kind == "bool":
                found[f.name] = {"true": True, "1": True, "false": False, "0": False}[text.lower()]
            else:
                found[f.name] = int(text) if kind == "int" else float(text)
        except (KeyError, ValueError):
            raise ValueError(f"{f.name} can't be {text!r}: it is {kind}") from None
    return EngineConf(**found)


DEFAULT = EngineConf()
