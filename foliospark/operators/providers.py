"""Calls of outside providers (embedding, reranking, expanding, answering) from within tasks.

A provider is a function of a list of rows (dicts) to a list of replies, one for each row, None where it has none. It is called
with batches of bounded size, some at a time, each with a time limit; what fails for a reason that may pass is asked again
after a growing pause, and of a batch answered in part only the rest. No row is lost and none fails the job: a row has its reply or a
status that says why not, so that the rest can be put aside and asked another time.
"""

from __future__ import annotations

import json
import queue
import socket
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.worker import shared
from .spotting import kept


@dataclass(frozen=True)
class Policy:
    batch: int = 32  # rows a call
    timeout: float = 60.0  # seconds a call
    attempts: int = 6  # calls for a row at most
    backoff: float = 1.0  # seconds before the second call, doubled for each further one
    backoff_most: float = 15.0
    concurrency: int = 2  # calls of a task at a time
    stalled_most: int = 16  # calls of a worker that may hang before it calls no more


class Refused(Exception):
    """Raised by a provider for what it will never answer: it isn't asked again."""


class _Stalled:
    """Calls that went over their time and can't be stopped; a worker counts them."""

    def __init__(self):
        self.n, self.lock = 0, threading.Lock()

    def add(self, k: int) -> None:
        with self.lock:
            self.n += k


def stalled() -> _Stalled:
    return shared("stalled", _Stalled)


def pause(attempt: int, policy: Policy) -> float:
    """Seconds after so many failed calls."""
    return min(policy.backoff_most, policy.backoff * 2 ** (attempt - 1))


def status_of(error: Exception) -> str:
    """What went wrong, in the words of a status."""
    if isinstance(error, urllib.error.HTTPError):
        return f"http_error:{error.code}"
    if isinstance(error, (urllib.error.URLError, ConnectionError)):
        return f"http_unreachable:{type(error).__name__}"
    if isinstance(error, (TimeoutError, socket.timeout)):
        return "timeout"
    if isinstance(error, json.JSONDecodeError):
        return "parse_error"
    return f"refused:{error}" if isinstance(error, Refused) else f"failed:{type(error).__name__}"


def passes(error: Exception) -> bool:
    """Whether another call may succeed where this one failed."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return not isinstance(error, Refused)


def _timed(call: Callable, rows: list[dict], seconds: float):
    """The reply of one call, or TimeoutError. The call has a thread of its own, which is left behind if it hangs."""
    done: queue.Queue = queue.Queue(1)
    over = threading.Event()

    def run() -> None:
        try:
            done.put((call(rows), None))
        except Exception as e:  # whatever a provider raises is its status
            done.put((None, e))
        if over.is_set():
            stalled().add(-1)

    threading.Thread(target=run, daemon=True).start()
    try:
        got, error = done.get(timeout=seconds)
    except queue.Empty:
        stalled().add(1)
        over.set()
        raise TimeoutError from None
    if error is not None:
        raise error
    return got


def answered(call: Callable, rows: list[dict], policy: Policy, fits: Callable | None = None) -> list[tuple[object, str | None, int]]:
    """(reply, status, attempts) for each of rows, which are one batch."""
    out: list[tuple[object, str | None, int]] = [(None, "not_asked", 0)] * len(rows)
    left, attempt = list(range(len(rows))), 0
    while left and attempt < policy.attempts:
        if attempt:
            time.sleep(pause(attempt, policy))
        if stalled().n >= policy.stalled_most:
            for k in left:
                out[k] = (None, "provider_stalled", attempt)
            break
        attempt += 1
        try:
            got = _timed(call, [rows[k] for k in left], policy.timeout)
            if not isinstance(got, (list, tuple)) or len(got) != len(left):
                got, why = [None] * len(left), "bad_format"
            else:
                why = "no_reply"
            again = True
        except Exception as e:  # a status, not a failed task
            got, why, again = [None] * len(left), status_of(e), passes(e)
        for k, reply in zip(left, got):
            bad = fits(reply) if reply is not None and fits is not None else None
            out[k] = (reply, None, attempt) if reply is not None and bad is None else (None, bad or why, attempt)
        left = [k for k in left if out[k][1] is not None] if again else []
    return out


def _in_flight(batches: Iterator[tuple[pa.RecordBatch, list[dict]]], call: Callable, policy: Policy, fits: Callable | None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with their answers, in order; at most policy.concurrency are asked at a time."""
    waiting: deque = deque()

    def start(rows: list[dict]) -> queue.Queue:
        done: queue.Queue = queue.Queue(1)
        threading.Thread(target=lambda: done.put(answered(call, rows, policy, fits)), daemon=True).start()
        return done

    for batch, rows in batches:
        waiting.append((batch, start(rows)))
        if len(waiting) >= policy.concurrency:
            first, done = waiting.popleft()
            yield first, done.get()
    for first, done in waiting:
        yield first, done.get()


def asked(rows: DataFrame, call: Callable[[list[dict]], list], reply: str, policy: Policy = Policy(), fits: Callable | None = None) -> DataFrame:
    """rows with reply (of the type named), status (null if there is a reply) and attempts.

    fits: a function of a reply to None, or to a status if it is not what was asked for; such a row is asked again. Replies are kept once
    they are there, so what follows doesn't ask a second time; a task that is lost is asked again whole.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"reply {reply}").fields, StructField("status", StringType()), StructField("attempts", IntegerType())])
    kinds, names = [to_arrow_schema(schema).field(n).type for n in ("reply", "status", "attempts")], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((p, p.to_pylist()) for b in batches for k in range(0, b.num_rows, policy.batch) for p in [b.slice(k, policy.batch)])
        for part, got in _in_flight(parts, call, policy, fits):
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(zip(*got), kinds))], names)

    return kept(rows.mapInArrow(run, schema))


def dead_letters(done: DataFrame) -> DataFrame:
    """Rows without a reply, as asked() takes them again, and why."""
    return done.filter("status is not null").drop("reply")


def http_json(url: str, body: Callable[[list[dict]], object], replies: Callable[[object, list[dict]], list], headers: dict[str, str] | None = None, timeout: float = 60.0) -> Callable[[list[dict]], list]:
    """A provider that posts JSON: body makes what is sent of a batch, replies makes its replies of what comes back."""

    def call(rows: list[dict]) -> list:
        data = json.dumps(body(rows), ensure_ascii=False).encode()
        request = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json", **(headers or {})}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return replies(json.loads(r.read().decode("utf-8", "replace")), rows)

    return call


def reranked_pairs(pairs: DataFrame, call: Callable[[list[dict]], list], policy: Policy = Policy(batch=1), chars: int = 800) -> DataFrame:
    """(qid, chunk_id, rerank_score, status, attempts) of pairs (qid, chunk_id, question, text), a question with all its passages a row.

    The provider gets {question, passages: [{chunk_id, text}]}, texts cut to `chars`, and gives {chunk_id: score}. Scores are clamped to 0
    to 1, passages without one have 0; without a reply a question has null scores, and keeps its order (fusion.rerank_where_scored).
    """
    from ..functions.text import clamp01, strip, truncate

    ids = F.col("chunk_id").cast("string")
    text = truncate(strip(F.replace("text", F.lit("\r\n"), F.lit("\n"))), chars)
    rows = pairs.groupBy("qid", "question").agg(F.sort_array(F.collect_list(F.struct(ids.alias("chunk_id"), text.alias("text")))).alias("passages"))  # candidates of one question
    fits = lambda r: None if isinstance(r, dict) and any(isinstance(v, (int, float)) for v in r.values()) else "bad_output"
    clean = lambda got: [r and {str(k): float(v) for k, v in r.items() if isinstance(v, (int, float))} if isinstance(r, dict) else r for r in got]
    done = asked(rows, lambda batch: clean(call(batch)), "map<string,double>", policy, fits)
    back = pairs.select("qid", "chunk_id", ids.alias("__id")).join(done.select("qid", "reply", "status", "attempts"), "qid", "left")
    score = F.when(F.col("status").isNull(), clamp01(F.coalesce(F.try_element_at("reply", F.col("__id")), F.lit(0.0))))
    return back.select("qid", "chunk_id", score.alias("rerank_score"), "status", "attempts")
