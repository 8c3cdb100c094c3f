"""Document fingerprints from closed syncmers over words (native DataFrame operations only).

A run of K words is a closed syncmer if the smallest hash among its runs of S words is the first or the last of them.
That depends on the run alone, so equal passages give equal anchors wherever they stand.  The fingerprint keeps every
anchor of a text, its hash and its position, so it grows with the text.  Two fingerprints are compared by position:
common anchors in a row that stand at one offset to each other form a run, and the heaviest chain of runs that follow
each other in both texts counts, so passages in another order are less alike than passages in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import range_of

K, S = 4, 2
_SOURCE, _LOW = 1 << 31, (1 << 31) - 1
#: Rows that a range of ids holds on average; ranges are window partitions.
RANGE_ROWS, MOST_RANGES = 2000, 8192


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: (position, hash) of every closed syncmer of ``text``.

    Two runs of K words in a row hold an anchor for sure; a text of at most K words also has each word as an anchor.

    Each step is a column of its own, so that the arrays are made once and not inside the loops that read them.
    """
    words, inner, count = f"{out}_words", f"{out}_inner", K - S + 1
    w, h, n = F.col(f"`{words}`"), F.col(f"`{inner}`"), F.size(F.col(f"`{words}`"))
    df = df.withColumn(words, F.transform(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn(inner, F.zip_with(w, F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    def at(first: Column, i: Column) -> Column:
        last = F.get(h, i + count - 1)
        least = F.least(first, *(F.get(h, i + j) for j in range(1, count)))
        run = F.xxhash64(first, F.get(h, i + S), last)
        return F.when((i <= n - K) & ((first == least) | (last == least)),
                      F.struct(i.alias("position"), run.alias("hash")))

    found = F.filter(F.transform(h, at), lambda a: a.isNotNull())
    single = F.transform(w, lambda x, i: F.struct(i.alias("position"), F.xxhash64(x).alias("hash")))
    marks = F.when(n <= K, F.concat(found, single)).otherwise(found)
    return df.withColumn(out, marks).drop(words, inner)


def packed(marks: Column) -> Column:
    """Each anchor as a long: 32 bits of the hash, then the position."""
    return F.transform(marks, lambda a: F.shiftleft(F.shiftright(a["hash"], 32), 32).bitwiseOR(a["position"].cast("long")))


def fingerprint(anchors: Column) -> Column:
    """All packed anchors as 16 hexadecimal digits each, in the order of the text; empty for a text without words."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: 0 to 1, the aligned share of the packed anchors of ``a`` and ``b``; two empty ones are alike.

    With ``c`` anchors on the heaviest chain it is c / (anchors of a + anchors of b - c).  An anchor that a text repeats
    is paired by its turn: the first with the first, the second with the second.  The chain is found in a time that
    grows with the square of the number of runs, which edits leave small.
    """
    both, starts, pairs, cuts, runs, chain = (f"{out}_{x}" for x in ("both", "starts", "pairs", "cuts", "runs", "chain"))
    x, first, pair, cut, run = (F.col(f"`{c}`") for c in (both, starts, pairs, cuts, runs))
    left, right = F.col(f"`{a}`"), F.col(f"`{b}`")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    hash_of = lambda v: F.shiftright(v, 32)
    of_right = lambda v: v.bitwiseAND(F.lit(_SOURCE)) != 0
    place = lambda v: v.bitwiseAND(F.lit(_LOW))
    # Sorted by hash, then text, then position: each hash of both texts is one group.
    df = df.withColumn(both, F.when(left == right, F.array().cast("array<long>")).otherwise(
        F.sort_array(F.concat(left, F.transform(right, lambda v: v.bitwiseOR(F.lit(_SOURCE)))))))
    # Where the right text's part of a common hash begins: its neighbour before is of the left text.
    df = df.withColumn(starts, F.filter(numbers(F.size(x)), lambda i: (i > 0) & of_right(F.get(x, i)) & ~of_right(F.get(x, i - 1))
                                        & (hash_of(F.get(x, i)) == hash_of(F.get(x, i - 1)))))

    def back(i: Column) -> Column:
        """How many of the left text hold the hash at ``i``, by doubling the reach until its front is found."""
        same = lambda j: (j >= 0) & (hash_of(F.get(x, j)) == hash_of(F.get(x, i)))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(31))))
        return F.when(~same(i - 2), F.lit(1)).otherwise(F.aggregate(
            steps, F.lit(0), lambda n, step: F.when((i >= n + step) & same(i - n - step), n + step).otherwise(n)))

    def ahead(i: Column) -> Column:
        same = lambda j: (j < F.size(x)) & (hash_of(F.get(x, j)) == hash_of(F.get(x, i)))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(31))))
        return F.when(~same(i + 1), F.lit(1)).otherwise(F.aggregate(
            steps, F.lit(0), lambda n, step: F.when((F.size(x) - i >= n + step) & same(i + n + step - 1), n + step).otherwise(n)))

    def paired(i: Column) -> Column:
        n = back(i)
        return F.transform(F.sequence(F.lit(0), F.least(n, ahead(i)) - 1), lambda k: F.shiftleft(place(F.get(x, i - n + k)), 32).bitwiseOR(place(F.get(x, i + k))))

    # (position in a, position in b), by the position in a.
    df = df.withColumn(pairs, F.sort_array(F.flatten(F.transform(first, paired))))
    shift = lambda v: place(v) - hash_of(v)
    df = df.withColumn(cuts, F.filter(numbers(F.size(pair)), lambda i: (i == 0) | (shift(F.get(pair, i)) != shift(F.get(pair, i - 1)))))

    def run_of(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(cut, k + 1), F.size(pair))
        return F.struct(place(F.get(pair, i)).alias("first"), place(F.get(pair, end - 1)).alias("last"), (end - i).cast("long").alias("weight"))

    df = df.withColumn(runs, F.transform(cut, run_of))

    def longer(chains: Column, r: Column) -> Column:
        before = F.transform(F.filter(chains, lambda c: c["last"] < r["first"]), lambda c: c["weight"])
        return F.concat(chains, F.array(F.struct(r["last"].alias("last"), (r["weight"] + F.coalesce(F.array_max(before), F.lit(0))).alias("weight"))))

    none = F.array().cast("array<struct<last:long,weight:long>>")
    df = df.withColumn(chain, F.coalesce(F.aggregate(run, none, longer, lambda cs: F.array_max(F.transform(cs, lambda c: c["weight"]))), F.lit(0)))
    c = F.col(f"`{chain}`")
    share = F.when(left == right, F.lit(1.0)).otherwise(c / F.greatest(F.size(left) + F.size(right) - c, F.lit(1)))
    return df.withColumn(out, share).drop(both, starts, pairs, cuts, runs, chain)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, order, text, packed anchors) with text and anchors of the next row by ascending id.

    Ids are cut into ranges at approximate quantiles; each range is a window partition, and the first row of every
    range also visits the range before it, so that no window spans the table.
    """
    low = -(1 << 63)
    rows = docs.withColumn("order", F.coalesce(F.col("doc_id").cast("long"), F.lit(low)))
    # A first, narrow pass over the ids: quantiles, and then each range's smallest row (at most MOST_RANGES of them).
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("order"))
    n = ids.count()
    count = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    quantiles = ids.agg(F.percentile_approx("order", [i / count for i in range(1, count)] or [0.5],
                                            F.lit(10 * count))).first()[0] or []
    cuts = sorted(set(quantiles))
    place = range_of(F.struct(F.col("order").alias("k0")), [(int(c),) for c in cuts])
    firsts = sorted((r["range"], r["order"]) for r in ids.withColumn("range", place).groupBy("range")
                    .agg(F.min("order").alias("order")).collect())
    if not firsts:
        firsts = [(0, low)]
    # Of the rows of a range, those with its smallest id also go, as guests, to the range before (the last, if first).
    table = docs.sparkSession.createDataFrame(
        [(r, o, firsts[i - 1][0], i == 0) for i, (r, o) in enumerate(firsts)], "range int, order_min long, host int, turn boolean")
    rows = rows.withColumn("range", place).join(F.broadcast(table), "range")
    guest = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"), F.when(F.col("turn"), 1).otherwise(0).alias("late"))
    own = F.struct(F.col("range"), F.lit(False).alias("guest"), F.lit(0).alias("late"))
    visits = F.when(F.col("order") == F.col("order_min"), F.array(own, guest)).otherwise(F.array(own))
    rows = rows.withColumn("to", F.explode(visits)).select("doc_id", "order", "text", "anchors", "to.*")
    # Repeated ids: the text's hash decides, so the next row is the same in every run.  A guest stands after all.
    window = Window.partitionBy("range").orderBy("guest", "late", "order", F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(window)).withColumn(
        "next_anchors", F.lead("anchors").over(window)).where(~F.col("guest"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, whose last quarter comes from the next document.

    Null text counts as empty.  An empty text is its own edit.  The only row of a table is its own next document.
    Rows with equal id are ordered by text.  An empty table gives no rows.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = with_anchors(base, "text", "marks").withColumn("anchors", packed(F.col("marks"))).drop("marks")
    near = with_next(base).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    keep = (F.col("n_chars") - cut).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep), F.substring(F.col("next_text"), F.lit(1), cut))
    near = near.withColumn("edited", edited)
    near = near.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "next_text")
    near = with_anchors(near, "edited", "marks").withColumn("edited_anchors", packed(F.col("marks"))).drop("marks", "edited")
    near = with_likeness(with_likeness(near, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return near.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next")
