"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Each shingle of five words is hashed once; the top bits choose a bin, which keeps its least hash. An empty bin takes the value
of the first non-empty bin in its own pseudo-random order of all bins (optimal densification): that order depends on the bin
alone, so equal sets of shingles always borrow alike. Kept are the low ``BITS`` bits of each bin, packed; chance matches of
these bits are taken out of the likeness.

The whole computation is local to a row: hashes are sorted together with one sentinel per bin, the first hash of every bin is
its least, and a bin whose first is the sentinel is empty.

Defined results: a null text is the empty text; texts of fewer than five words are one shingle of all their words (empty text:
the empty shingle), so two empty texts have likeness 1; words are split at ASCII white space and keep their case; equal texts
have equal fingerprints; rows with equal doc_id follow each other by text (where one doc_id or null makes up several runs of
neighbours, by a hash of the text first); null doc_ids come last; a table of one row follows itself; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, text_or_empty

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
#: Steps of a bin's order that are tried one by one before all non-empty bins are compared.
PROBES = 6
#: Runs of neighbours that rows are dealt in at most, rows of a run in the mean at least, and bounds that are compared at once.
RUNS = 65536
RUN_ROWS = 256
BLOCK = 256

_LOW = (1 << 64 - BIN_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w) - (size - 1)
        rows = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(n, F.lit(0))) for i in range(size)])
        return F.when(n > 0, F.transform(rows, lambda s: F.xxhash64(s))).otherwise(F.array(F.xxhash64(F.concat_ws(" ", w))))

    return _let(words(text), of)


def _least_per_bin(hashes: Column) -> Column:
    """BINS hashes in the order of the bins, a sentinel where a bin is empty."""
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_LOW)))
    return _let(
        F.sort_array(F.concat(hashes, sentinels)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(s, i - 1), 64 - BIN_BITS))),
    )


def _orders() -> tuple[list[int], list[int], list[int]]:
    """Step, start and inverse step of each bin's order: the t-th bin tried is (step * t + start) mod BINS, step being odd."""
    steps, starts, x = [], [], 0x9E3779B97F4A7C15
    for _ in range(BINS):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        x ^= x >> 31
        steps.append(x % BINS | 1)
        starts.append((x >> 32) % BINS)
        x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    return steps, starts, [pow(s, -1, BINS) for s in steps]


def _densified(bins: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))
    steps, starts, inverses = _orders()
    tries = [F.lit([(s * t + a) % BINS for s, a in zip(steps, starts, strict=True)]) for t in range(PROBES)]
    start, inverse = F.lit(starts), F.lit(inverses)
    kept = F.transform(bins, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, x.bitwiseAND((1 << BITS) - 1).cast("int")))

    def dense(b: Column) -> Column:
        def filled(full: Column) -> Column:
            def one(i: Column) -> Column:
                turns = F.transform(full, lambda j: ((j - F.get(start, i)) * F.get(inverse, i)).bitwiseAND(BINS - 1) * BINS + j)
                return F.coalesce(F.get(b, i), *[F.get(b, F.get(t, i)) for t in tries], F.get(b, F.array_min(turns).bitwiseAND(BINS - 1)))

            return F.transform(numbers, one)

        return _let(F.filter(numbers, lambda i: F.get(b, i).isNotNull()), filled)

    return _let(kept, dense)


def fingerprint(text: Column) -> Column:
    """BINS numbers of BITS bits."""
    return _densified(_least_per_bin(shingle_hashes(text)))


def packed(numbers: Column) -> Column:
    """Two hexadecimal digits a bin, joined: unhex() of it are the packed bits."""
    return F.concat_ws("", F.transform(numbers, lambda v: F.lpad(F.hex(v), 2, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bins without those equal by chance, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty), bins, fingerprint."""
    rows = df.select(F.col(key), text_or_empty(text).alias("text"))
    return rows.withColumn("bins", fingerprint(F.col("text"))).withColumn("fingerprint", packed(F.col("bins")))


def _numbers(values: list, kind: str = "bigint") -> Column:
    """An array that the optimiser folds into one literal; an expression for each number would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _bounds_below(bounds: list[int], key: Column, or_equal: bool = False) -> Column:
    """The number of bounds (sorted) below key, or up to it: whole blocks first, then the bounds of one block."""
    if not bounds:
        return F.lit(0)
    under = lambda x: x <= key if or_equal else x < key
    whole = F.size(F.filter(_numbers(bounds[BLOCK - 1 :: BLOCK]), under)) if len(bounds) >= BLOCK else F.lit(0)
    return _let(whole * BLOCK, lambda at: at + F.size(F.filter(F.slice(_numbers(bounds), at + 1, F.lit(BLOCK)), under)))


def _quantiles(df: DataFrame, key: str, runs: int) -> list[int]:
    """Bounds of about equal runs of the key's values; a value that makes up several runs stands there as often."""
    shares = _numbers([i / runs for i in range(1, runs)], "double") if runs > 1 else None
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), shares, 4 * runs)).first()[0] if runs > 1 else None
    return sorted(found or [])


def with_next(df: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the columns of the next row by descending key as next_<column>; the row after the last is the first.

    Quantiles of the key cut the rows into runs of neighbours; a key that makes up several runs, or null, is cut again by a hash
    of the text. Rows are dealt out by run, once; the first row of each run travels to the run above as well, where it follows
    the last one.
    """
    k = F.col(key)
    n, known = df.agg(F.count(F.lit(1)), F.count(k)).first()
    runs = min(RUNS, max(1, n // RUN_ROWS))
    bounds, of_nulls = _quantiles(df, key, runs), (n - known) * runs // max(n, 1)
    hot = of_nulls > 1 or len(set(bounds)) < len(bounds)

    def part(m: Column) -> Column:
        """The lower the hash, the higher the run of m."""
        return m - 1 - F.shiftright((F.shiftright("_h", 33) + (1 << 30)) * m, 31)

    below, upto = _bounds_below(bounds, k), _bounds_below(bounds, k, True)
    run = below + F.when(upto - below > 1, part(upto - below)).otherwise(F.lit(0)) if hot else below
    run = F.when(k.isNull(), part(F.lit(of_nulls)) if of_nulls else F.lit(0)).otherwise(run + of_nulls)
    placed = df.withColumn("_h", F.xxhash64(text) if hot else F.lit(0).cast("long")).withColumn("_run", run.cast("int"))
    top = F.max(F.struct(k.cast("long").alias("k"), F.bitwise_not("_h").alias("h")))
    tops = {r["_run"]: r["top"] for r in placed.groupBy("_run").agg(top.alias("top")).collect()}  # a row for each run
    order = sorted(tops) or [0]
    above, all_runs = dict(zip(order, [*order[1:], order[0]], strict=True)), range(order[-1] + 1)

    def of_run(value) -> Column:
        return F.element_at(_numbers([value(tops[x]) if x in tops else 0 for x in all_runs]), F.col("_run") + 1)

    null_top = of_run(lambda t: int(t["k"] is None)) == 1
    first = F.when(k.isNull(), null_top).otherwise(~null_top & (k == of_run(lambda t: t["k"] or 0))) & (F.bitwise_not("_h") == of_run(lambda t: t["h"]))
    up = F.element_at(_numbers([above.get(x, 0) for x in all_runs]), F.col("_run") + 1).cast("int")
    home, visit = (F.struct(r.alias("run"), F.lit(guest).alias("guest")) for r, guest in ((F.col("_run"), False), (up, True)))
    dealt = placed.withColumn("_to", F.explode(F.when(first, F.array(home, visit)).otherwise(F.array(home))))
    down = Window.partitionBy("_to.run").orderBy(F.col("_to.guest"), k.desc_nulls_last(), F.col("_h"), F.col(text))
    return dealt.withColumn("_next", F.lead(F.struct(*columns)).over(down)).where(~F.col("_to.guest")).select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def op2_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(fingerprints(documents(spark, sf_dir, "doc_id", "text")).drop("fingerprint"), ["text", "bins"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))")
    edited = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.withColumn("edited_bins", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
