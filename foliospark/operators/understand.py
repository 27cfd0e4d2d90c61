"""What a question asks for: scalar functions over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import CJK, strip

#: Patterns and words that results depend on.
SENSITIVE = r"(?iu)(系统提示词|system\s*prompt|developer\s*message|开发者消息|提示词|prompt\s*injection|越狱|jailbreak|请输出.*提示词|把.*提示词.*输出|你.*(规则|指令).*内容|secret|api\s*key|密钥|口令|密码)"
MAPPING_HINT = r"(分别|各自|各是谁|分别是谁|分别是|各自是)"
LIST_INTENT = r"(列出|列举|哪些|有哪些|谁是|哪几位|都有谁|都有哪些)"
CRITERIA_HINT = r"(判定标准|标准|依据|何为|什么才算|如何定义|算作|算是)"
FIELD_STOP = ("什么", "哪些", "多少", "谁", "是谁", "是否", "怎么", "为何", "为什么", "哪里", "哪位", "哪种", "分别", "各自", "情况", "信息", "内容", "方面", "问题", "答案")
CRITERIA_STOP = ("哪些", "有哪些", "谁是", "哪几位", "都有谁", "都有哪些", "的人", "的人物", "的角色", "的同学", "同学", "人物", "角色")
KEYWORD_STOP = ("什么", "怎么", "为什么", "为何", "哪里", "哪个", "哪些", "是否", "能否", "可以", "一下", "一段", "原文", "台词", "逐字", "引用", "剧情", "结局")
FIELD_PATTERNS = (
    r"([一-鿿、/，和及与]{2,40})\s*(?:分别|各自)\s*(?:是|为|有哪些|有什么|是谁|是什么)?",
    r"的\s*([一-鿿、/，和及与]{2,40})\s*(?:是|为|有哪些|有什么|分别|分别是)?",
    r"([一-鿿、/，和及与]{2,40})\s*(?:是什么|有哪些|有什么|分别是|分别为)\s*$",
)
TARGET_STOP = ("什么", "哪些", "多少", "谁", "是谁", "是否", "怎么", "为何", "为什么", "哪里", "哪位", "哪种", "分别", "各自")
PREFIX = r"(?iu)^\s*(?:忽略(?:以上|所有)?(?:规则|指令|要求|限制)|不要(?:引用|标注|来源)|直接(?:编|生成)(?:一个)?答案|无视(?:以上|所有)?(?:规则|指令|要求)|)\s*[：:，,。.\n\r]+"
TEMPORAL = r"(第一次|首次|最早|初次|初登场|第一次出现|首次出现|第一次出场|首次出场|第一次登场)"
TEMPORAL_NOISE = r"(怎样|怎么|如何|什么|是怎|他说|做了|说了|做什么|场景|台词|动作)"
GENERIC = ("人物", "角色", "谁", "哪位", "哪人", "这人", "这个人")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def should_block(q: Column) -> Column:
    return strip(q).rlike(SENSITIVE)


def normalise(q: Column) -> Column:
    """The part of a question that retrieval should see."""
    text = strip(q)
    tail = strip(F.regexp_extract(text, r"(?s)(?:请)?(?:解释并回答|并回答|回答)\s*[：:]\s*(.+)$", 1))
    text = F.when(tail != "", tail).otherwise(text)
    bare = strip(F.regexp_replace(text, PREFIX, ""))
    text = F.when(bare != "", bare).otherwise(text)
    for mark in ("问题：", "问题:"):
        tail = strip(F.substring_index(text, mark, -1))
        text = F.when(F.contains(text, F.lit(mark)) & (tail != ""), tail).otherwise(text)
    return strip(text)


def mapping_field(q: Column) -> Column:
    first = F.regexp_extract(q, r"([一-鿿]{1,10})\s*分别(?:是|是谁|是什么)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.regexp_extract(q, r"的\s*([一-鿿]{1,10})\s*分别", 1), F.lit("")))


def fields(q: Column) -> Column:
    """Names of what is asked about, in order and without repeats."""
    def terms(run: Column) -> Column:
        return F.filter(F.split(run, r"[、/,，和及与]"), lambda t: (t != "") & ~t.isin(*FIELD_STOP) & t.rlike(f"^{CJK}{{1,20}}$"))

    found = F.array_distinct(F.flatten(F.concat(*[F.transform(_all(q, p, 1), terms) for p in FIELD_PATTERNS])))
    spare = F.array_distinct(F.filter(_all(q, r"的\s*([一-鿿]{1,12})", 1), lambda t: ~t.isin(*FIELD_STOP)))
    one = mapping_field(q)
    return F.when(one.isNotNull(), F.array(one)).when(F.size(found) > 0, found).otherwise(spare)


def is_list(q: Column) -> Column:
    return strip(q).rlike(LIST_INTENT)


def needs_criteria(q: Column) -> Column:
    return strip(q).rlike(CRITERIA_HINT)


def criteria(q: Column) -> Column:
    first = F.regexp_extract(q, r"(?:的|中)([一-鿿]{2,20})\s*(?:有哪些|是谁|哪些|哪几位|都有谁|都有哪些)", 1)
    second = F.regexp_extract(q, r"(?:哪些|哪几位|有哪些)\s*([一-鿿]{2,20})", 1)
    fit = lambda x: F.when((x != "") & ~x.isin(*CRITERIA_STOP), x)
    return F.coalesce(fit(first), fit(second))


def keywords(q: Column, most: int = 6) -> Column:
    """Words and CJK runs of two characters or more, without stop words and repeats."""
    return F.slice(F.array_distinct(F.filter(_all(q, f"[A-Za-z0-9]{{2,}}|{CJK}{{2,}}"), lambda t: ~t.isin(*KEYWORD_STOP))), 1, most)


def plan_kind(q: Column, targets: Column, n: Column) -> Column:
    """mapping, multi_field, target_field or null, from a question, the names it is about and how many fields it has."""
    some = F.size(targets) > 0
    return F.when(strip(q).rlike(MAPPING_HINT) & (n > 0) & (F.size(targets) >= 2), "mapping").when((n >= 2) & some, "multi_field").when((n >= 1) & some, "target_field")


def is_noise(e: Column) -> Column:
    """Whether a name can't be what a question is about."""
    return (F.length(e) <= 1) | e.isin(*TARGET_STOP) | e.rlike(r"^\p{Nd}+$")


def spans(q: Column, most: int = 8) -> Column:
    """Runs of CJK characters that stand for names where none is known, without dots and repeats."""
    bare = F.transform(_all(strip(q), r"[一-鿿·]{2,10}"), lambda s: strip(F.replace(s, F.lit("·"), F.lit(""))))
    return F.slice(F.array_distinct(F.filter(bare, lambda s: ~is_noise(s))), 1, most)


def plan_keywords(q: Column, asked: Column, targets: Column, most: int = 6) -> Column:
    """Fields, targets, then further words of a question, without repeats."""
    words = F.filter(_all(q, f"[A-Za-z0-9]{{2,}}|{CJK}{{2,}}"), lambda t: ~t.isin(*FIELD_STOP, *TARGET_STOP))
    return F.slice(F.array_distinct(F.concat(asked, targets, words)), 1, most)


def subqueries(targets: Column, asked: Column, words: Column) -> Column:
    """target + field + keywords (words, joined) for each pair, then all together; without repeats, max(3, 2 * targets + 1) at most."""
    each = F.flatten(F.transform(targets, lambda t: F.transform(asked, lambda f: strip(F.concat_ws(" ", t, f, words)))))
    last = strip(F.concat_ws(" ", F.array_join(targets, " "), F.array_join(asked, " "), words))
    return F.slice(F.array_distinct(F.concat(each, F.array(last))), F.lit(1), F.greatest(F.lit(3), 2 * F.size(targets) + 1))


def is_temporal(q: Column) -> Column:
    """Whether a question asks for a first appearance."""
    return strip(q).rlike(TEMPORAL)


def temporal_target(q: Column) -> Column:
    """The name before a mark of first appearance; null if there is none."""
    left = F.regexp_extract(strip(q), r"(?s)^(.*?)" + TEMPORAL, 1)
    names = F.filter(_all(left, r"[一-鿿·]{2,12}"), lambda c: ~c.rlike(TEMPORAL_NOISE) & ~c.isin(*GENERIC))
    return F.when(strip(q).rlike(TEMPORAL), F.try_element_at(names, F.lit(-1)))


def without_noise(names: Column, most: int = 3) -> Column:
    """Names without words of actions and questions; all of them if none is left."""
    clean = F.filter(names, lambda c: ~c.rlike(TEMPORAL_NOISE))
    return F.slice(F.when(F.size(clean) > 0, clean).otherwise(names), 1, most)
