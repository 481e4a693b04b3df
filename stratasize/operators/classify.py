"""Classification of machines into workloads: rules first, then similarity, then a default."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.functions.rules import FALLBACK_PRIORITY, Rule, default_rules, folded
from stratasize.functions.tables import GENERIC_VM, LARGE_GENERIC_MIB, UNKNOWN
from stratasize.operators.filters import in_ranges, numbered_by_ranges
from stratasize.operators.rule_index import RULE_FIELDS, rule_number_by_index
from stratasize.sources.sinks import stored

#: A similarity below this one gives no verdict (fixed value).
THRESHOLD = 0.5
#: Rules that become one CASE; more of them are a table with an index of literals.
MOST_IN_CASE = 500
#: Patterns in a step of the CASE.
BLOCK_PATTERNS = 40
_RULE_COLUMNS = tuple(f"__rule_{f}" for f in RULE_FIELDS)


def _signals(df: DataFrame, prefixes: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """(name less its prefixes, OS, folder, description), never null."""
    have = lambda c: X.text_or_empty(F.col(c)) if c in df.columns else F.lit("")
    return X.without_role_prefix(X.without_company_prefix(have("vm_name"), prefixes)), have("os_name"), have("vm_folder"), have("vm_description")


def _first(rules: Sequence[tuple[int, Rule]], hit) -> Column:
    """The number of the first rule that matches, as one CASE in the plan; null for none."""
    out = None
    for i, r in rules:
        out = F.when(hit(r), F.lit(i)) if out is None else out.when(hit(r), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def _blocks(rules: Sequence[tuple[int, Rule]]) -> list[list[tuple[int, Rule]]]:
    """rules in blocks of about BLOCK_PATTERNS patterns."""
    out, held = [], BLOCK_PATTERNS
    for i, r in rules:
        own = len(r.names) * (1 + r.description) + len(r.systems) + len(r.folders) + 1
        if held + own > BLOCK_PATTERNS:
            out, held = [*out, []], 0
        out[-1].append((i, r))
        held += own
    return out


def rule_number(df: DataFrame, rules: Sequence[Rule], prefixes: Sequence[str] = (), name: str = "rule_no") -> DataFrame:
    """df with the number in rules (which are in order of priority) of the first that matches the name, OS or folder, or
    else, for rules that allow it, the description. With a description, the direct pass leaves out fallback rules, so a
    description can win over them. null if none matches.

    Rules become literal predicates: a narrow projection without join or shuffle, evaluated until the first match; the
    CASE gives a number, so that it stands in the plan once however many of the rule's fields are asked for. It is cut
    into blocks, each a step of its own that is passed over once a rule was found: the JVM compiles no method of more than
    8,000 bytes, and one CASE over the pack is several times that.
    """
    signals = dict(zip(("__name", "__system", "__folder", "__description"), _signals(df, prefixes), strict=True))
    # The signals are columns of their own, so they are worked out once for a row and not for each rule.
    rows = df.withColumns(signals).withColumns({f"{c}_low": folded(F.col(c)) for c in signals})
    name_, system, folder, description = (F.col(c) for c in signals)
    low = [F.col(f"{c}_low") for c in signals]
    numbered = list(enumerate(rules))
    direct = [_first(b, lambda r: r.matches(name_, system, folder, low=low) & ((description == "") if r.priority >= FALLBACK_PRIORITY else F.lit(True))) for b in _blocks(numbered)]
    second = []
    if "vm_description" in df.columns:
        told = [(i, r) for i, r in numbered if r.description or r.priority >= FALLBACK_PRIORITY]
        second = [F.when(description != "", _first(b, lambda r: r.matches(name_, system, folder, description, low))) for b in _blocks(told)]
    found = None
    for i, block in enumerate([*direct, *second] or [F.lit(None).cast("int")]):
        # A generator of one row: the optimiser pushes no filter through it, which would evaluate the CASE once more.
        rows = rows.select("*", F.explode(F.array(block if found is None else F.coalesce(found, block))).alias(f"__found_{i}"))
        if found is not None:
            rows = rows.drop(f"__found_{i - 1}")
        found = F.col(f"__found_{i}")
    return rows.withColumn(name, found).drop(f"__found_{i}", *signals, *[f"{c}_low" for c in signals])


def rule_field(rules: Sequence[Rule], field: str, default: str, number: str = "rule_no") -> Column:
    """A field of the rule with a row's number."""
    if not rules:
        return F.lit(default)
    if len(rules) > MOST_IN_CASE:
        return F.coalesce(F.col(f"__rule_{field}"), F.lit(default))
    # Not coalesce(): Spark takes an element of an array of literals for never null, even at a null index.
    return F.when(F.col(number).isNotNull(), F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col(number) + 1)).otherwise(F.lit(default))


def _ordered(rules: Sequence[Rule] | None) -> list[Rule]:
    return sorted(default_rules() if rules is None else rules, key=lambda r: r.priority)


def _numbered(df: DataFrame, rules: Sequence[Rule], prefixes: Sequence[str]) -> DataFrame:
    if len(rules) <= MOST_IN_CASE:
        return rule_number(df, rules, prefixes)
    return rule_number_by_index(df, rules, _signals(df, prefixes))


def classify_by_registry(df: DataFrame, rules: Sequence[Rule] | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """All rules, fallbacks included: workload_category, workload_subcategory, classification_rule and _confidence. Up to
    MOST_IN_CASE rules are one CASE in the plan, more of them a table; the verdicts are the same."""
    rules = _ordered(rules)
    fields = {"workload_category": ("category", UNKNOWN), "workload_subcategory": ("subcategory", UNKNOWN), "classification_rule": ("name", "default"), "classification_confidence": ("confidence", "default")}
    return _numbered(df, rules, prefixes).withColumns({k: rule_field(rules, f, d) for k, (f, d) in fields.items()}).drop("rule_no", *_RULE_COLUMNS)


def classify(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    similarity: DataFrame | None = None,
    prefixes: Sequence[str] = (),
    threshold: float = THRESHOLD,
    large_mib: float = LARGE_GENERIC_MIB,
    key: str = "row_index",
) -> DataFrame:
    """The cascade: a rule of an application gives confidence `override`; else the similarity's best route from the
    threshold on gives `semantic`; else Unknown by `default`. Then semantic and default rows in a generic subcategory
    of large_mib or more go to File / General Purpose.

    similarity: (key, route, category, subcategory, score), one row at most for a key; see best_routes().
    """
    rules = _ordered(rules)
    # Fallback rules never give a verdict here; one that would match hides no later rule, since they come last.
    rules = [r for r in rules if r.priority < FALLBACK_PRIORITY]
    out, by_rule = _numbered(df, rules, prefixes), F.col("rule_no").isNotNull()
    pick = lambda field, default: F.when(by_rule, rule_field(rules, field, default)).otherwise(F.lit(default))
    verdict = {"workload_category": pick("category", UNKNOWN), "workload_subcategory": pick("subcategory", UNKNOWN)}
    verdict |= {"classification_rule": F.when(by_rule, F.concat(F.lit("override:"), rule_field(rules, "name", "default"))).otherwise("default"), "classification_confidence": F.when(by_rule, "override").otherwise("default")}
    out = out.withColumns(verdict).drop("rule_no", *_RULE_COLUMNS)
    return _rerouted(out, large_mib) if similarity is None else add_similarity(out, similarity, threshold, large_mib, key)


def add_similarity(ruled: DataFrame, similarity: DataFrame, threshold: float = THRESHOLD, large_mib: float = LARGE_GENERIC_MIB, key: str = "row_index") -> DataFrame:
    """classify()'s rows with the similarity's verdict where no rule gave one and a route scores the threshold or more."""
    best = similarity.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("route", "category", "subcategory", "score")])
    alike = (F.col("classification_confidence") == "default") & F.coalesce(F.col("__score") >= threshold, F.lit(False))
    told = F.concat(F.lit("semantic:"), F.regexp_replace("__route", "^learned:", ""), F.lit(" (score "), F.format_number("__score", 2), F.lit(")"))
    new = {"workload_category": F.col("__category"), "workload_subcategory": F.col("__subcategory"), "classification_rule": told, "classification_confidence": F.lit("semantic")}
    found = ruled.join(best, F.col(key) == F.col("__key"), "left").withColumn("__alike", alike)
    found = found.withColumns({c: F.when(F.col("__alike"), v).otherwise(F.col(c)) for c, v in new.items()})
    return _rerouted(found.drop("__alike", "__key", "__route", "__category", "__subcategory", "__score"), large_mib)


def _rerouted(rows: DataFrame, large_mib: float) -> DataFrame:
    """Rows of large machines in a generic workload that no rule named go to File / General Purpose."""
    if "provisioned_mib" not in rows.columns:
        return rows
    generic = (F.col("classification_confidence") != "override") & F.col("workload_subcategory").isin(GENERIC_VM, UNKNOWN) & (X.number_in(rows, "provisioned_mib") >= large_mib)
    moved = {"workload_category": "File", "workload_subcategory": "General Purpose", "classification_rule": "Large generic (>=100 GiB)"}
    return rows.withColumn("__large", generic).withColumns({c: F.when(F.col("__large"), v).otherwise(F.col(c)) for c, v in moved.items()}).drop("__large")


def text_of(df: DataFrame, name: str = "text") -> DataFrame:
    """df with the text that similarity compares: name, OS and description, the empty ones left out."""
    have = lambda c: X.text_or_empty(F.col(c)) if c in df.columns else F.lit("")
    return df.withColumn(name, X.joined_text(have("vm_name"), have("os_name"), have("vm_description")))


def gram_vector(text: Column, width: int = 3, size: int = 256) -> Column:
    """A unit vector of hashed character n-grams of a lower-cased text: the encoder for when no other vectors are at hand.
    null for a null text or one shorter than an n-gram. Arrow batches; the hash is a CRC, the same everywhere."""

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        out, known = [], {}  # the CRC of each n-gram, once for a batch
        for t in texts.to_pylist():
            low = f" {t.lower()} ".encode() if t is not None else b""
            grams = [low[i : i + width] for i in range(len(low) - width + 1)]
            for g in grams:
                if g not in known:
                    known[g] = zlib.crc32(g) % size
            counts = np.bincount([known[g] for g in grams], minlength=size) if grams else None
            out.append(None if counts is None else counts / np.linalg.norm(counts))
        return pa.array(out, pa.list_(pa.float64()))

    return encode(text)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one length; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def best_routes(
    vectors: DataFrame, exemplars: DataFrame, key: str = "row_index", nearest: int = 1, threshold: float | None = None, bound: int = 20_000, by: Sequence[str] = ()
) -> DataFrame:
    """(key, route, category, subcategory, score): the best route of each vector.

    vectors: (key, vector); exemplars: (route, category, subcategory, vector). A route's score is the mean of the cosines
    of its `nearest` best exemplars; of equal scores the first route by name wins. Null and zero vectors, those with null
    components, and those of another length than their exemplars, have no score; neither do such exemplars count.
    With `by`, columns of both tables that name an inventory, an exemplar counts in its own inventory only, or in all if
    its columns are null (for nearest = 1).
    Up to `bound` exemplars go to the tasks as one matrix, and rows are scored batch by batch where they are; more of
    them meet the rows in blocks of both (see _routes_by_product()), or, with `by`, only where a bound says that they can
    win (see _routes_by_pivots()).
    """
    if by and nearest != 1:
        raise ValueError("exemplars within inventories are compared by the nearest one")
    e = exemplars.select(*by, "route", "category", "subcategory", F.col("vector").cast("array<double>").alias("e"))
    if by:
        own = F.lit(False)
        for c in by:
            own = own | F.col(c).isNotNull()
        general = best_routes(vectors, exemplars.where(~own).drop(*by), key, 1, None, bound)
        floor = general.select(F.col(key).alias("__k"), F.col("score").alias("floor"))
        known = vectors.select(*by, key, "vector").join(floor, F.col(key) == F.col("__k"), "left").drop("__k")
        both = general.unionByName(_routes_by_pivots(known, e.where(own), key, by))
        best = both.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "route", "category", "subcategory")).alias("b"))
        out = best.select(key, "b.route", "b.category", "b.subcategory", (-F.col("b.minus")).alias("score"))
        return out if threshold is None else out.where(F.col("score") >= threshold)
    known = e.limit(bound + 1).toArrow()
    if known.num_rows > bound:
        out = _routes_by_product(vectors, e, key, threshold) if nearest == 1 else _routes_by_join(vectors, e, key, nearest)
    elif not known.num_rows:
        out = vectors.limit(0).select(key, *[F.lit(None).cast(t).alias(n) for n, t in (("route", "string"), ("category", "string"), ("subcategory", "string"), ("score", "double"))])
    else:
        out = _routes_by_matrix(vectors, known, key, nearest)
    return out if threshold is None else out.where(F.col("score") >= threshold)


#: Exemplars that share a pivot, on the average; pivots at most; rows that meet a block of exemplars in one task.
BLOCK_EXEMPLARS, MOST_PIVOTS, BLOCK_ROWS = 500, 4_000, 20_000
#: What rounding may add to an angle.
_SLACK = 1e-7


def _unit(vector: str) -> Column:
    """The vector at length 1; null where it is null, zero, or has a null component."""
    # The sum is a variable of the last function; as an expression it would be summed again for each component.
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.when(s > 0, F.transform(vector, lambda x: x / F.sqrt(s))))


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, none of them null, as rows."""
    flat = pa.chunked_array([values]).combine_chunks() if isinstance(values, pa.Array) else values.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1 if len(flat) else 0)


def _angles(values: pa.Array, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_matrix(values) @ pivots.T, -1.0, 1.0)) if len(values) else np.zeros((0, len(pivots)))


def candidate_blocks(vectors: DataFrame, e: DataFrame, block_exemplars: int = BLOCK_EXEMPLARS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None:
    """(e with the block of each exemplar, a function that gives rows the blocks in which they may find their best).

    e: (e, ...) and rows (v, floor, ...), unit vectors. Pivots are exemplars, the first by hash; an exemplar's block is
    its nearest pivot, and a block's radius the widest angle in it. An exemplar of a block is no nearer to a row than the
    pivot's angle less the radius, so blocks whose bound is below the row's `floor` (a score that it has already) are left
    out. Without a floor the nearest pivot's block comes first: it is given alone.
    """
    n = e.count()
    k = min(MOST_PIVOTS, -(-n // block_exemplars))
    if not n:
        return None
    chosen = [r["e"] for r in e.select("e").orderBy(F.xxhash64("e"), "e").limit(k).collect()]  # MOST_PIVOTS vectors at most
    pivots = np.array(chosen)

    @F.arrow_udf("struct<block:int,angle:double>")
    def near(values: pa.Array) -> pa.Array:
        a = _angles(values, pivots)
        at = a.argmin(1)
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(a[np.arange(len(at)), at])], ["block", "angle"])

    blocked = stored(e.withColumn("n", near(F.col("e"))).select(*e.columns, "n.block", "n.angle"), "exemplar-blocks")
    radius = np.full(len(pivots), -np.inf)
    for r in blocked.groupBy("block").agg(F.max("angle").alias("r")).collect():  # a row for each pivot
        radius[r["block"]] = r["r"]

    def given(rows: DataFrame) -> DataFrame:
        @F.arrow_udf("array<int>")
        def pick(values: pa.Array, floors: pa.Array) -> pa.Array:
            a = _angles(values, pivots)
            limit, out = np.arccos(np.clip(floors.to_numpy(zero_copy_only=False).astype(float), -1.0, 1.0)), []
            for own, most in zip(a, limit, strict=True):
                out.append([int(own.argmin())] if np.isnan(most) else np.flatnonzero(own - radius <= most + _SLACK).tolist())
            return pa.array(out, pa.list_(pa.int32()))

        return rows.withColumn("block", F.explode(pick(F.col("v"), F.col("floor"))))

    return blocked, given


def _routes_by_pivots(vectors: DataFrame, e: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The nearest exemplar's route of each vector (key, vector, `by`, and floor: a score it has already, or none).

    Rows meet the block of their nearest pivot first, which gives a score, and then only blocks whose bound reaches it
    (candidate_blocks()). A block meets BLOCK_ROWS rows a task, so no block gathers more. Lengths are compared apart.
    """
    of_length = lambda c, name: F.coalesce(F.size(c), F.lit(0)).alias(name)
    e = stored(e.where("NOT exists(e, x -> x IS NULL)").withColumn("e", _unit("e")).where("e IS NOT NULL").distinct(), "exemplars")
    floor = F.col("floor") if "floor" in vectors.columns else F.lit(None).cast("double")
    rows = vectors.select(*by, F.col(key).cast("long").alias("k"), F.col("vector").cast("array<double>").alias("v"), floor.alias("floor"))
    rows = stored(rows.where("NOT exists(v, x -> x IS NULL)").withColumn("v", _unit("v")).where("v IS NOT NULL"), "route-rows")
    parts = []
    for r in e.select(of_length("e", "d")).distinct().collect():
        own = rows.where(F.size("v") == r["d"])
        blocked, given = candidate_blocks(own, e.where(F.size("e") == r["d"]))
        first = stored(_scored_blocks(given(own.withColumn("floor", F.lit(None).cast("double"))), blocked, by), "first-blocks")
        # The better of the score so far and the first block's; rows without either meet all blocks.
        reached = own.join(first.groupBy("k").agg(F.max("score").alias("__s")), "k", "left").withColumn("floor", F.coalesce(F.greatest("floor", "__s"), F.lit(-1.0))).drop("__s")
        parts += [first, _scored_blocks(given(reached), blocked, by)]
    if not parts:
        return vectors.limit(0).select(key, *[F.lit(None).cast(t).alias(n) for n, t in (("route", "string"), ("category", "string"), ("subcategory", "string"), ("score", "double"))])
    every = reduce(lambda a, b: a.unionByName(b), parts)
    best = every.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("minus"), "route", "category", "subcategory")).alias("b"))
    return best.select(F.col("k").alias(key), "b.route", "b.category", "b.subcategory", (-F.col("b.minus")).alias("score"))


def _scored_blocks(rows: DataFrame, blocked: DataFrame, by: Sequence[str]) -> DataFrame:
    """(k, route, category, subcategory, score): the best of each row in each block that it was given."""
    rows = stored(rows.drop("floor"), "given-blocks")
    keys = ["block", *by]
    salts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("salts")).withColumnsRenamed({c: f"__{c}" for c in keys})
    met = F.lit(True)
    for c in keys:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    drop = [f"__{c}" for c in keys]
    left = rows.join(salts, met).withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int")).drop("salts", *drop)
    right = blocked.drop("angle").join(salts, met).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", *drop)

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if own.num_rows and known.num_rows:
            names = list(zip(*(known[c].to_pylist() for c in ("route", "category", "subcategory")), strict=True))
            order = sorted(range(len(names)), key=lambda i: names[i])  # of equal scores the first name wins
            matrix = _matrix(known["e"])[order]
            for some in own.select(["k", "v"]).to_batches(max_chunksize=512):
                cos = _matrix(some.column(1)) @ matrix.T
                at = cos.argmax(1)
                out[0] += some.column(0).to_pylist()
                for j in range(3):
                    out[1 + j] += [names[order[i]][j] for i in at]
                out[4] += cos[np.arange(len(at)), at].tolist()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["k", "route", "category", "subcategory", "score"])

    keys = [*keys, "salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "k long, route string, category string, subcategory string, score double")


#: Exemplars and rows of a pair of blocks; exemplars multiplied at once; rows that share a bound, widest first.
PRODUCT_EXEMPLARS, PRODUCT_ROWS, PRODUCT_STEP, BOUND_ROWS = 400_000, 200_000, 50_000, (16, 4)
#: Rows of a block at least, where there are tasks to spare.
LEAST_PRODUCT_ROWS = 500
#: What single precision may add to a cosine of so many components.
_SINGLE = 2.0**-23


def _packed_unit(vector: Column) -> Column:
    """(d, bits, values): the vector's length, which components aren't zero, and these at length 1, so that sparse vectors
    travel small. null where the vector is null, zero, or has a null component."""

    @F.arrow_udf("struct<d:int,bits:binary,values:binary>")
    def pack(vectors: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for i, whole in enumerate((vectors.is_valid()).to_pylist()):
            own = vectors[i].values if whole else None
            x = own.to_numpy(zero_copy_only=False) if own is not None and not own.null_count else np.zeros(0)
            norm = np.sqrt(x @ x)
            there = x != 0
            out.append({"d": len(x), "bits": np.packbits(there).tobytes(), "values": (x[there] / norm).tobytes()} if norm > 0 else None)
        return pa.array(out, pa.struct([("d", pa.int32()), ("bits", pa.binary()), ("values", pa.binary())]))

    return pack(vector)


def _unpacked(rows: pa.Table) -> np.ndarray:
    """The vectors of packed rows of one length."""
    d = rows["d"][0].as_py() if rows.num_rows else 0
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    out = np.zeros((rows.num_rows, d))
    out[np.unpackbits(bits, axis=1, count=d).astype(bool)] = np.frombuffer(b"".join(rows["values"].to_pylist()))
    return out


def _may_reach(x: np.ndarray, floors: np.ndarray, known: np.ndarray, slack: float, widths: Sequence[int]) -> Iterator[tuple[slice, np.ndarray | None]]:
    """Rows of x in runs, each with the rows of known with which one of them may reach its floor (None for all). Of vectors
    without negative components no row's product exceeds that of its run's largest components."""
    if not widths:
        yield from ((slice(i, i + 256), None) for i in range(0, len(x), 256))
        return
    starts = np.arange(0, len(x), widths[0])
    top = np.maximum.reduceat(x, starts)
    reach = top @ known.T >= (np.minimum.reduceat(floors, starts) - slack * np.maximum(np.linalg.norm(top, axis=1), 1))[:, None]
    for begin, own in zip(starts.tolist(), reach, strict=True):
        at, end = np.flatnonzero(own), min(begin + widths[0], len(x))
        if not len(at):
            continue
        few = 4 * len(at) < len(own)
        for run, some in _may_reach(x[begin:end], floors[begin:end], known[at] if few else known, slack, widths[1:]):
            chosen = at if some is None and few else at[some] if few else some
            yield slice(begin + run.start, begin + run.stop), chosen


def _best_of_block(own: pa.Table, known: pa.Table, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of own's rows its best cosine, if it reaches floor, to twelve digits (else -inf), and the first of known's
    rows that has it."""
    x = np.concatenate([_unpacked(own.slice(i, PRODUCT_STEP)).astype(np.float32) for i in range(0, own.num_rows, PRODUCT_STEP)])
    best, best_at, plain = np.full(len(x), -np.inf), np.zeros(len(x), np.int64), not (x < 0).any()
    for begin in range(0, known.num_rows, PRODUCT_STEP):
        matrix = _unpacked(known.slice(begin, PRODUCT_STEP))
        single, slack = matrix.astype(np.float32), 2 * (matrix.shape[1] + 2) * _SINGLE
        widths = BOUND_ROWS if plain and not (matrix < 0).any() else ()
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048]
            floors = np.maximum(best[i : i + len(part)], floor)
            pairs = []
            for run, some in _may_reach(part, floors, single, slack, widths if np.isfinite(floors).all() else ()):
                cos = part[run] @ (single if some is None else single[some]).T
                row, at = np.nonzero(cos >= np.maximum(cos.max(1), floors[run])[:, None] - slack)
                pairs.append((row + run.start, at if some is None else some[at]))
            if not pairs or not len(row := np.concatenate([r for r, _ in pairs])):
                continue
            at = np.concatenate([c for _, c in pairs])
            met, of = np.unique(row, return_inverse=True)
            double = _unpacked(own.take(pa.array(met + i)))
            exact = np.concatenate([np.einsum("ij,ij->i", double[of[j : j + 8192]], matrix[at[j : j + 8192]]) for j in range(0, len(row), 8192)]).round(12)
            first = np.lexsort((at, -exact, row))
            first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
            first = first[(exact[first] >= floor) & (exact[first] > best[row[first] + i])]  # earlier exemplars win ties
            best[row[first] + i], best_at[row[first] + i] = exact[first], at[first] + begin
    return best, best_at


def _routes_by_product(vectors: DataFrame, e: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """The nearest exemplar's route of each vector, of any number of both: each block of rows meets each block of
    exemplars, in matrix products in single precision. What comes within its rounding of a row's best is scored again
    in double precision, to twelve digits, so that equal cosines are equal and the first route by name wins. Below
    `threshold` a row has no result. Neighbouring rows share a bound, their largest components' product, and are multiplied
    only by exemplars whose bound reaches the threshold, or the least of their best so far.

    Vectors travel packed, a copy of a row for each block of exemplars and the other way round. A task holds one block of
    each, whatever the tables' sizes; the work is rows times exemplars, less what the bound saves.
    """
    unit = lambda df: df.where("u IS NOT NULL").select(*[c for c in df.columns if c != "u"], "u.*")
    known = stored(unit(e.withColumn("u", _packed_unit(F.col("e"))).drop("e")), "exemplars")
    rows = stored(unit(vectors.select(F.col(key).cast("long").alias("k"), _packed_unit(F.col("vector").cast("array<double>")).alias("u"))), "route-rows")
    n, tasks = rows.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism
    blocks, row_blocks = max(1, -(-known.count() // PRODUCT_EXEMPLARS)), max(1, -(-n // PRODUCT_ROWS))
    row_blocks = max(row_blocks, min(-(-tasks // blocks), n // LEAST_PRODUCT_ROWS))
    # Like rows are neighbours: in the order of about how many components they have, and of which. Short ones meet more
    # exemplars than long ones, so stretches are dealt to all blocks.
    laid = numbered_by_ranges(rows.withColumn("size", F.expr("length(values) div 64")), ["size", "bits", "values", "k"], name="n")
    left = laid.drop("size").withColumn("x", F.expr(f"n div 256 % {row_blocks}").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = known.withColumn("y", F.pmod(F.xxhash64("route", "bits", "values"), F.lit(blocks)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    floor = -np.inf if threshold is None else threshold

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        kinds = pa.schema([("k", pa.int64()), ("route", pa.string()), ("category", pa.string()), ("subcategory", pa.string()), ("score", pa.float64())])
        if not own.num_rows or not known.num_rows:
            return kinds.empty_table()
        names = ["route", "category", "subcategory"]
        known = known.take(pc.sort_indices(known, [(x, "ascending") for x in names], null_placement="at_start"))  # of equal scores the first name wins
        own = own.take(pc.sort_indices(own, [("n", "ascending")]))
        best, at = _best_of_block(own, known, floor)
        found = np.flatnonzero(best > -np.inf)
        named = known.select(names).take(pa.array(at[found]))
        return pa.Table.from_arrays([own["k"].take(pa.array(found)), *named.columns, pa.array(best[found])], schema=kinds)

    # A number of tasks by blocks: few bytes are much work here, so that tasks joined by their bytes would be few.
    keys, tasks = ["d", "x", "y"], max(blocks * row_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(score, "k long, route string, category string, subcategory string, score double")
    best = scored.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("minus"), "route", "category", "subcategory")).alias("b"))
    return best.select(F.col("k").alias(key), "b.route", "b.category", "b.subcategory", (-F.col("b.minus")).alias("score"))


def _routes_by_matrix(vectors: DataFrame, known: pa.Table, key: str, nearest: int) -> DataFrame:
    rows = sorted((r for r in known.to_pylist() if r["e"] and None not in r["e"] and any(r["e"])), key=lambda r: (r["route"], r["category"], r["subcategory"]))
    routes = sorted({(r["route"], r["category"], r["subcategory"]) for r in rows})
    of = np.array([routes.index((r["route"], r["category"], r["subcategory"])) for r in rows])
    matrices = {d: (np.array([r["e"] for r in rows if len(r["e"]) == d]), of[[len(r["e"]) == d for r in rows]]) for d in {len(r["e"]) for r in rows}}
    matrices = {d: (m / np.linalg.norm(m, axis=1, keepdims=True), r) for d, (m, r) in matrices.items()}
    kind = "struct<route:string,category:string,subcategory:string,score:double>"

    @F.arrow_udf(kind)
    def judge(batch: pa.Array) -> pa.Array:
        values = batch.to_pylist()
        best: list[dict | None] = [None] * len(values)
        for d, (matrix, route) in matrices.items():
            at = [i for i, v in enumerate(values) if v is not None and len(v) == d and None not in v and any(v)]
            for begin in range(0, len(at), 1024):
                some = at[begin : begin + 1024]
                x = np.array([values[i] for i in some], dtype=np.float64)
                cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix.T
                scores = np.full((len(some), len(routes)), -np.inf)
                for r in np.unique(route):
                    own = np.sort(cos[:, route == r], axis=1)[:, ::-1][:, :nearest]
                    scores[:, r] = own.mean(axis=1)
                for i, r, s in zip(some, scores.argmax(axis=1), scores.max(axis=1), strict=True):
                    best[i] = dict(zip(("route", "category", "subcategory"), routes[r], strict=True)) | {"score": float(s)}
        return pa.array(best, pa.struct([("route", pa.string()), ("category", pa.string()), ("subcategory", pa.string()), ("score", pa.float64())]))

    found = vectors.select(key, judge(F.col("vector")).alias("b")).where("b IS NOT NULL")
    return found.select(key, "b.route", "b.category", "b.subcategory", "b.score")


def _routes_by_join(vectors: DataFrame, e: DataFrame, key: str, nearest: int) -> DataFrame:
    """Rows and exemplars in blocks: each block of rows meets each block of exemplars, a matrix product at a time, and
    only the best cosines of a row and route leave a pair of blocks."""
    blocks, row_blocks = max(1, -(-e.count() // 20_000)), max(1, -(-vectors.count() // 20_000))
    vectors = vectors.select(F.col(key).cast("long").alias("k"), F.col("vector").cast("array<double>").alias("v"))
    left = vectors.withColumn("x", F.pmod(F.xxhash64("k"), F.lit(row_blocks)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = e.withColumn("y", F.pmod(F.xxhash64("route", "e"), F.lit(blocks)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        routes, of = {}, []
        held = [(r, v) for r, v in zip(zip(*(known[c].to_pylist() for c in ("route", "category", "subcategory")), strict=True), known["e"].to_pylist(), strict=True) if v and None not in v and any(v)]
        for r, _ in held:
            of.append(routes.setdefault(r, len(routes)))
        names, of, out = list(routes), np.array(of, np.int64), []
        values = [(k, v) for k, v in zip(rows["k"].to_pylist(), rows["v"].to_pylist(), strict=True) if v and None not in v and any(v)]
        for d in {len(v) for _, v in held} & {len(v) for _, v in values}:
            at = [i for i, (_, v) in enumerate(held) if len(v) == d]
            matrix, route = np.array([held[i][1] for i in at]), of[at]
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            own = [(k, v) for k, v in values if len(v) == d]
            for begin in range(0, len(own), 512):
                some = own[begin : begin + 512]
                x = np.array([v for _, v in some])
                cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix.T
                for r in np.unique(route):
                    best = -np.sort(-cos[:, route == r], axis=1)[:, :nearest]
                    out += [(k, *names[r], row) for (k, _), row in zip(some, best.tolist(), strict=True)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "route", "category", "subcategory", "top"])

    scored = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(score, "k long, route string, category string, subcategory string, top array<double>")
    scored = scored.withColumnRenamed("k", key)
    top = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, nearest)
    scored = scored.groupBy(key, "route", "category", "subcategory").agg(top.alias("top"))
    scored = scored.withColumn("score", F.aggregate("top", F.lit(0.0), lambda s, v: s + v) / F.size("top"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "route", "category", "subcategory")).alias("b"))
    return best.select(key, "b.route", "b.category", "b.subcategory", (-F.col("b.minus")).alias("score"))


def learned_exemplars(classified: DataFrame, exemplars: DataFrame, most: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(`by`, route, category, subcategory, utterance): the exemplars and the names of machines that a rule classified, for
    workloads that have a route; learned routes are named `learned:...`, which display drops. Names are learned within an
    inventory (columns `by`, null for given exemplars, which count in all; a null inventory learns nothing). most:
    distinct names of a route that are learned at most (the first by hash), which bounds what is broadcast later."""
    base = exemplars.select("category", "subcategory").distinct()
    inside = classified.where(F.col("classification_confidence") == "override").dropna(subset=list(by)) if by else classified.where(F.col("classification_confidence") == "override")
    names = inside.select(*by, F.col("workload_category").alias("category"), F.col("workload_subcategory").alias("subcategory"), F.col("vm_name").alias("utterance")).distinct()
    names = names.join(base, ["category", "subcategory"], "left_semi")
    if most is not None:
        order = W.partitionBy(*by, "category", "subcategory").orderBy(F.xxhash64("utterance"), "utterance")
        names = names.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
    given = exemplars.withColumns({c: F.lit(None).cast(classified.schema[c].dataType) for c in by}) if by else exemplars
    return given.unionByName(names.select(*by, F.concat(F.lit("learned:"), F.concat_ws("/", "category", "subcategory")).alias("route"), "category", "subcategory", "utterance"))


def distribution(classified: DataFrame, by: Sequence[str] = ("classification_confidence", "workload_category", "workload_subcategory")) -> DataFrame:
    """(kind, value, vms): counts by each column, most frequent first, in one pass."""
    sets = classified.groupingSets([[F.col(c)] for c in by], *[F.col(c) for c in by]).agg(F.count(F.lit(1)).alias("vms"), *[F.grouping(c).alias(f"__{i}") for i, c in enumerate(by)])
    kind = F.coalesce(*[F.when(F.col(f"__{i}") == 0, F.lit(c)) for i, c in enumerate(by)])
    return sets.select(kind.alias("kind"), F.coalesce(*by).alias("value"), "vms").orderBy("kind", F.desc("vms"), "value")


def evaluate_thresholds(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """scored: (route, label, score). A row for each route and threshold: rows, those at or above it, right ones, accuracy
    and coverage. The thresholds are literals, exploded in each row."""
    grid = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.col("score") >= F.col("threshold")
    out = grid.groupBy("route", "threshold").agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("accepted"), F.count_if(hit & (F.col("route") == F.col("label"))).alias("right"))
    return out.withColumns({"accuracy": F.coalesce(F.try_divide("right", "accepted"), F.lit(0.0)), "coverage": F.col("accepted") / F.col("rows")})


def sweep_thresholds(scored: DataFrame) -> DataFrame:
    """evaluate_thresholds() with each score of a route as a threshold, in one ordered sweep.

    Equal scores are counted first. Distinct ones are dealt to ranges by route and falling score; the counts of a route's
    earlier ranges, and a running sum within a range, give what is at or above each score. No task sees more than a
    range, however many scores a route has. Null scores are rows that no threshold accepts.
    """
    counts = scored.groupBy("route", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == F.col("label")).alias("hits"))
    laid = in_ranges(counts.where("score IS NOT NULL"), ["route", F.col("score").desc()]).withColumn("part", F.shiftrightunsigned("__place", 33))
    by_part = laid.groupBy("route", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))  # a row for each route and range
    earlier = W.partitionBy("route").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select(F.col("route").alias("r"), F.col("part").alias("p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "hits")])
    upto = W.partitionBy("route", "part").orderBy("__place")
    rows = laid.join(before, F.col("route").eqNullSafe(F.col("r")) & (F.col("part") == F.col("p")))
    rows = rows.select("route", F.col("score").alias("threshold"), *[(F.sum(c).over(upto) + F.col(f"{c}_before")).alias(name) for c, name in (("n", "accepted"), ("hits", "right"))])
    all_ = counts.groupBy(F.col("route").alias("r")).agg(F.sum("n").alias("rows"))
    out = rows.join(all_, F.col("route").eqNullSafe(F.col("r"))).select("route", "threshold", "rows", "accepted", "right")
    return out.withColumns({"accuracy": F.col("right") / F.col("accepted"), "coverage": F.col("accepted") / F.col("rows")})


def fit_thresholds(scored: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """(route, threshold, accuracy, coverage): each route's most accurate threshold, of those the one that covers most; of
    all its scores, or of the thresholds given."""
    found = sweep_thresholds(scored) if thresholds is None else evaluate_thresholds(scored, thresholds)
    return found.groupBy("route").agg(F.max(F.struct("accuracy", "coverage", "threshold")).alias("b")).select("route", "b.threshold", "b.accuracy", "b.coverage")
