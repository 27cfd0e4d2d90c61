"""Replies that arrive in pieces, cleaned sentence by sentence as they come.

A sentence is cleaned and given on as soon as its end has arrived, so however a reply is cut into pieces, what is given on is together the text that
evidence.clean_style() makes of the whole. Pieces that arrive too early wait in the state of their question.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.evidence import KEPT_LABELS, META_CLAUSE, META_PREFIX, META_WORDS, NO_ANSWER, REFUSAL

PIECE = "qid LONG, seq LONG, delta STRING, last BOOLEAN"
OUT = "qid LONG, no LONG, kind STRING, text STRING"
STATE = "seq LONG, no LONG, held STRING, said STRING, early STRING"
_PREFIX, _CLAUSE = (re.compile(p.replace("(?iU)", ""), re.I) for p in (META_PREFIX, META_CLAUSE))
_WORDS = re.compile("|".join(META_WORDS))


def clean_sentence(sentence: str) -> str:
    """One sentence, as evidence.clean_style() has it; empty if nothing of it is shown."""
    s = sentence.strip()
    if re.search("|".join(KEPT_LABELS), s):
        return s
    if _CLAUSE.search(s) and len(_CLAUSE.sub("", s).strip()) <= 2:
        return ""
    bare = _CLAUSE.sub("", _PREFIX.sub("", s).strip()).strip()
    return _WORDS.sub("", bare).strip() if _WORDS.search(bare) else bare


def refused(text: str) -> bool:
    t = text.strip()
    return not t or t == NO_ANSWER or len(t) <= 90 and bool(re.search(REFUSAL, t))


def _given_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, no, held, said, early = state.get if state.exists else (0, 0, "", "", "{}")
    waiting = {int(k): v for k, v in json.loads(early).items()}
    for pdf in batches:
        for n, delta, last in zip(pdf["seq"], pdf["delta"], pdf["last"]):
            if n >= seq:  # a piece that came before is no news
                waiting.setdefault(int(n), [delta or "", bool(last)])
    out, ended = [], seq < 0
    while seq in waiting and not ended:
        delta, ended = waiting.pop(seq)
        seq, held = seq + 1, held + delta
        *whole, held = re.split(r"(?<=[。！？\n])", held)
        if ended:
            whole, held = [*whole, held], ""
        for s in whole:
            if text := clean_sentence(s):
                out.append((key[0], no, "delta", text))
                no, said = no + 1, said + text
    if ended and seq >= 0:
        out.append((key[0], no, "refused" if refused(said) else "done", said))
        seq, held, said, waiting = -1, "", "", {}  # what arrives later is dropped
    state.update((seq, no, held, said, json.dumps(waiting)))
    yield pd.DataFrame(out, columns=["qid", "no", "kind", "text"]).astype({"qid": "int64", "no": "int64"})


def cleaned(pieces: DataFrame) -> DataFrame:
    """(qid, no, kind, text) from a stream of pieces (qid, seq, delta, last): sentences in order (delta), then the whole text as done, or
    as refused, where a consumer shows something else in its place. seq counts from 0; repeated pieces count once."""
    rows = pieces.selectExpr("qid", "seq", "delta", "coalesce(last, false) AS last")
    return rows.groupBy("qid").applyInPandasWithState(_given_on, OUT, STATE, "append", "NoTimeout")
