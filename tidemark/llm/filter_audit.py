"""Filter interaction audit: what each filter removes under every order of the filters, by Lehmer-rank difference arrays.

Every row gets a mask of the filters that it fails, whatever the order; rows are counted by part and mask, and nothing
after that grows with them. Orders are numbered by their lexicographic (Lehmer) rank. A row goes at step k exactly under
those orders whose first k letters end in a filter that it fails and hold no other such filter: orders with a common
beginning have consecutive ranks, so each mask and step cover a few intervals of ranks (``removal_intervals``). Its count
is added where an interval begins and taken off where it ends, and a running sum over the ranks gives the removed rows of
every order and step at once. The table of intervals depends on the number of filters alone and is broadcast.

Copies (filter E of ``op13``) are found by SHA-256: equal ids and texts are counted before any shuffle, then one row a
digest, part and mask tells how many of its rows have the smallest id. A row without id is never a copy and has no label.
Null text: empty. Null part: empty string. Several labels of a document: it is good or toxic if any says so. Empty table:
empty result. A text's words are held while it is looked at, so the longest text bounds the memory. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
#: Of eight filters there are 40,320 orders; beyond that the report, not the rows, would be the work.
MOST_FILTERS = 8


def orders(letters: str) -> list[str]:
    """All orders of the letters by rank."""
    return ["".join(p) for p in permutations(sorted(letters))]


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, low, high): rows that fail the filters in ``mask`` go at ``step`` under the orders of rank low to high - 1."""
    out: dict[tuple[int, int], list[list[int]]] = {}

    def under(before: list[int], rank: int) -> None:
        width = factorial(filters - len(before) - 1)
        passed = sum(1 << i for i in before)
        for place, i in enumerate(i for i in range(filters) if i not in before):
            low = rank + place * width
            for mask in range(1 << filters):
                if mask >> i & 1 and not mask & passed:
                    own = out.setdefault((mask, len(before) + 1), [])
                    if own and own[-1][1] == low:  # ranks come in order, so neighbours join
                        own[-1][1] = low + width
                    else:
                        own.append([low, low + width])
            if len(before) + 1 < filters:
                under([*before, i], low)

    under([], 0)
    return [(mask, step, low, high) for (mask, step), own in sorted(out.items()) for low, high in own]


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The report of (part, mask, n, good, toxic), where bit i of ``mask`` is set for rows that fail filter i by name.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): see ``op13``.
    """
    letters = "".join(sorted(letters))
    if not 1 <= len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} different letters, not {letters!r}")
    spark, size, names = counts.sparkSession, len(letters), orders(letters)
    totals = counts.groupBy("part", "mask").agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES))
    totals = written(spark, totals, "audit-counts")  # a row a part and mask; read three times
    covers = spark.createDataFrame(removal_intervals(size), "mask int, step int, low int, high int")
    ends = F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")))
    changes = totals.join(F.broadcast(covers), "mask").withColumn("end", F.explode(ends))
    changes = changes.select("part", "step", "end.rank", *((F.col("end.sign") * F.col(m)).alias(m) for m in MEASURES))
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(size)]
    only = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(size)]
    parts = totals.groupBy("part").agg(F.sum("n").alias("all"), F.array(*failing).alias("failing"), F.array(*only).alias("only"))
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("rank"), *(F.lit(0).cast("long").alias(m) for m in MEASURES))
    deltas = grid.unionByName(changes).groupBy("part", "step", "rank").agg(*(F.sum(m).alias(m) for m in MEASURES))
    along = Window.partitionBy("part", "step").orderBy("rank")
    gone = deltas.select("part", "step", "rank", *(F.sum(m).over(along).alias(m) for m in MEASURES)).where(F.col("rank") < len(names))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("rank") + 1)
    letter = F.substring(name, F.col("step"), F.lit(1))
    rows = gone.withColumns({"filter_order": name, "letter": letter, "before": F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))})
    rows = rows.withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "letter"))).join(parts, "part")
    place = F.instr(F.lit(letters), F.col("letter"))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("all") - F.col("before")).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("failing", place) - F.col("n")).alias("redundant"), F.element_at("only", place).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def mask_of(conditions: Sequence[Column]) -> Column:
    """Bit i is set where condition i, true for rows that fail, holds."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0)).cast("int")


def text_conditions(text: Column, words: Column) -> list[Column]:
    """Filters A to D of ``op13`` on a text that is not null and its words."""
    points, others = (F.length(t).cast("long") for t in (text, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")))
    count, distinct = (F.size(w).cast("long") for w in (words, F.array_distinct(words)))
    return [count < 100, 100 * distinct < 80 * count, 100 * (points - others) > 10 * points, text.rlike("[#$%&*|]")]


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of all documents, with filter E, the copies, as the last bit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    digest = F.when(F.col("id").isNotNull(), F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    marked = rows.select("id", "part", mask_of(text_conditions(F.col("text"), F.col("words"))).alias("mask"), digest.alias("digest"))
    same = marked.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    known = same.join(told, "id", "left").fillna(0, ["good", "toxic"])
    copies = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("first_n"), F.sum("n").alias("n"))
    # a few rows a digest by now: as many as it has parts and kinds of labels
    least = F.min("first").over(Window.partitionBy("digest"))
    original = F.when(F.col("first").isNull(), F.col("n")).when(F.col("first") == least, F.col("first_n")).otherwise(0)
    split = copies.withColumn("original", original)
    copy_bit = 1 << (len(LETTERS) - 1)
    sides = F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct(F.col("mask").bitwiseOR(copy_bit).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", "s.mask", "s.n", *((F.col("s.n") * F.col(c)).alias(c) for c in ("good", "toxic")))
    return each.where("n > 0").groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over all documents by language, under all 120 orders."""
    return audit(masked_counts(docs, labels))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""with recursive
d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {_WORDS} as w from documents),
firsts as (select t, min(doc_id) as least from d group by t),
lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (
  select d.part, coalesce(good, 0) as good, coalesce(lab.toxic, 0) as toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > least, false)] as fails
  from d left join firsts on d.t = firsts.t left join lab on d.doc_id = lab.doc_id
), g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
letters as (select unnest([1, 2, 3, 4, 5]) as i, unnest(['A', 'B', 'C', 'D', 'E']) as l),
p as (
  select [i] as o, l as name from letters union all select list_append(o, i), name || l from p join letters on not list_contains(o, i) where len(o) < 5
), steps as (select o, name, unnest([1, 2, 3, 4, 5]) as step from p where len(o) = 5),
gone as (
  select g.part, name, step, o[step] as i, sum(n) as total,
    sum(n) filter (fails[o[step]]) as failing,
    sum(n) filter (fails[o[step]] and len(list_filter(o[1:step - 1], lambda x: fails[x])) = 0) as removed,
    sum(n) filter (len(list_filter(o[1:step], lambda x: fails[x])) = 0) as kept,
    sum(n) filter (fails[o[step]] and len(list_filter(o, lambda x: fails[x])) = 1) as unique_fails,
    sum(good) filter (fails[o[step]] and len(list_filter(o[1:step - 1], lambda x: fails[x])) = 0) as good_lost,
    sum(toxic) filter (fails[o[step]] and len(list_filter(o[1:step - 1], lambda x: fails[x])) = 0) as toxic_lost
  from g cross join steps group by all
)
select part, name as filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, (coalesce(failing, 0) - coalesce(removed, 0))::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, i), 0)::bigint as shapley
from gone"""
