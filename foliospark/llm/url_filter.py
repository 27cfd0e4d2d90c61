"""URL filters by a bit-parallel automaton.

All rules are packed as patterns into one row of 64-bit words, one bit per pattern position. A batch of URLs is read
character by character; each step shifts every pattern of every URL at once (Shift-And) and keeps the places whose
character fits. A star is a place that stays set while its own class of characters is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains under paths that start with its path; longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Where no rule fits, a URL that one of these globs matches (over "." + host + path) is blocked, any other allowed.
GLOBS = ("*.free-bets.*", "*casino*", "*porn*", "*xxx*", "*viagra*", "*.bets.*", "*/login*", "*/cart/*", "*/wp-admin/*", "*/ads/*", "*.exe", "*.zip")
LEFT, ANY = "\x00", "\x01"  # what a star may pass over: the host only, or anything


@dataclass
class Automaton:
    """masks: [character class, word]; loop: where stars stay, per class; first, last: the patterns' ends, in order."""

    n_words: int
    masks: np.ndarray
    loop: np.ndarray
    first: np.ndarray
    ends: list[tuple[int, int]]
    code: np.ndarray  # character below 128 to its class; 0 is any other


def compile_globs(globs: list[str]) -> Automaton:
    """Packs globs; '*' passes over anything, LEFT over anything but '/'. Every pattern is matched against whole texts."""
    chars = sorted({c for g in globs for c in g} - {"*", LEFT})
    code = np.zeros(128, np.int64)
    for k, c in enumerate(chars, 1):
        code[ord(c)] = k
    slash = code[ord("/")]
    places: list[tuple[str, bool]] = []  # per bit: the character that leads into it, and whether a star stays on it
    ends, starts, loops = [], [], []
    for g in globs:
        starts.append(len(places))
        places.append(("", False))
        loops.append("")
        for c in g:
            if c in ("*", LEFT):
                loops[-1] = c
            else:
                places.append((c, False))
                loops.append("")
        ends.append(len(places) - 1)
    n_words = -(-len(places) // 64)
    masks, loop = np.zeros((len(chars) + 1, n_words), np.uint64), np.zeros((len(chars) + 1, n_words), np.uint64)
    for bit, (c, _) in enumerate(places):
        if c:
            masks[code[ord(c)], bit // 64] |= np.uint64(1 << bit % 64)
        if loops[bit]:
            loop[:, bit // 64] |= np.uint64(1 << bit % 64)
            if loops[bit] == LEFT and slash:
                loop[slash, bit // 64] &= ~np.uint64(1 << bit % 64)
    first = np.zeros(n_words, np.uint64)
    for s in starts:
        first[s // 64] |= np.uint64(1 << s % 64)
    return Automaton(n_words, masks, loop, first, [(e // 64, e % 64) for e in ends], code)


def run(a: Automaton, texts: list[str]) -> np.ndarray:
    """[text, pattern]: whether the pattern matches the whole text. Longer texts are read on alone when shorter ones end."""
    out = np.zeros((len(texts), len(a.ends)), bool)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for lo in range(0, len(order), 4096):
        part = order[lo : lo + 4096]
        lens = np.array([len(texts[i]) for i in part])
        points = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.where(points < 128, a.code[np.minimum(points, 127)], 0)
        starts = np.cumsum(lens) - lens
        state = np.tile(a.first, (len(part), 1))
        for at in range(int(lens.max(initial=0))):
            live = int(np.searchsorted(-lens, -at))  # texts longer than at come first
            c = classes[starts[:live] + at]
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & a.masks[c]) | (s & a.loop[c])
        out[part] = np.stack([(state[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in a.ends], 1).astype(bool)
    return out


def host(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' without '://' and for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple = RULES, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (host + path of the longest that fits, else null), verdict.

    Rules of equal length go by the longer host, then block before allow. Null urls and urls without '://' have empty
    host and path, fit no rule and are allowed. Repeated rows get equal verdicts, an empty table gives an empty result, and urls
    of any length are read whole. Other columns are ignored.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    patterns = [f"{LEFT}.{h}{p}*" for _, h, p in ranked] + list(globs)
    automaton, names, verdicts = compile_globs(patterns), [h + p for _, h, p in ranked], [v for v, _, _ in ranked]

    @F.pandas_udf("rule string, verdict string")
    def decide(h: pd.Series, p: pd.Series) -> pd.DataFrame:
        got = run(automaton, ["." + x + y for x, y in zip(h, p)])
        rule_at, any_rule = got[:, : len(names)].argmax(1) if names else np.zeros(len(got), int), got[:, : len(names)].any(1)
        bad = got[:, len(names) :].any(1)
        return pd.DataFrame({"rule": [names[k] if y else None for k, y in zip(rule_at, any_rule)], "verdict": [verdicts[k] if y else "block" if b else "allow" for k, y, b in zip(rule_at, any_rule, bad)]}, dtype=object)

    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return rows.withColumn("__d", decide("host", "path")).select("page_id", "host", "path", "__d.rule", "__d.verdict")
