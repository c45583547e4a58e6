"""Personal data (native): rules with proof by format, and boosted trees over the spans that loose generators propose.

Base spans are matches of one pattern a kind that pass the kind's check (byte range, Luhn sum, number of digits). Generators with high recall
propose further spans, which overlap; each is described by its format and its context. What the trees learn from is not what they see:

* Proven base spans are rewritten, in their own context, into forms that no base pattern proves (``VARIANTS``): an address with its signs spelt out or
  its dots in brackets, a telephone number without its country, a card number with other separators. These are the positives of the generators ``contact``, ``number``
  and ``dotted``; forms that look alike but hold no data (half an address, a version number, a date) are negatives.
* Secrets are labelled by their context (a value assigned to a key that names one), and the trees see their format alone.
* All other proposals in the texts are unlabelled. They count as negatives, but since some of them do hold data, a generator's together weigh no more
  than ``UNLABELLED`` says for each of its positives, and no leaf may rest on a few of them (``LEAF_WEIGHT``).

Documents are split into those to train on and those held out. For each generator the held-out positives give the highest threshold that keeps
``recall`` of them (unlabelled proposals can't tell a precision, as some do hold data); with few of them it is drawn towards ``PRIOR`` (by ``PRIOR_ROWS``), so that a small table uses nearly that and no
generator is dropped. Candidates above it are added to the base spans, which all stay.

Positions are code points, the end exclusive; they are summed up from the pieces between the matches, so no text is scanned twice for one.

Defined results: null and empty texts have no spans; without candidates of both classes nothing is added; rows that share a doc_id, or have none,
are told apart by their text; extra columns are never read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import cut, row_key, text_of

#: Kinds in the order in which spans that start together are listed, with their patterns. A match can begin only where the run of its
#: first characters begins, or where the last match ended: trying the run's inside never finds more, and costs its length squared.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "contact", "dotted")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold to have a match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KEYWORD = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)"
#: Loose generators: kind of the spans, pattern, and what a text must hold.
GENERATORS = {
    "secret": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{12,}+", r"[A-Za-z0-9+/_=-]{12}"),
    "number": (r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+", "[0-9][ ().-]{0,2}[0-9]"),
    "contact": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)*+", r"@|[(\[]at[)\]]"),
    "dotted": (r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]| ?[(\[]dot[)\]] ?)[0-9]{1,3}+){2,5}+(?![0-9])", r"[0-9](?:\.| ?[(\[])"),
}
#: For each kind of base span: pattern, replacement, whether the result holds personal data, and the generator that should propose it.
VARIANTS = {
    "email": (
        ("@", " [at] ", True, "contact"), ("@", "(at)", True, "contact"), (r"^([^@]+)@(?:[^.]+\.)*([^.]+)\.([^.]+)$", "$1 (at) $2 (dot) $3", True, "contact"), (r"@(?:[^.]+\.)*([^.]+\.[^.]+)$", "(at)$1", True, "contact"), (r"@(?:[^.]+\.)*([^.]+\.[^.]+)$", " [at] $1", True, "contact"), (r"^([^@]+)@(.+)\.([^.]+)$", "$1 [at] $2 [dot] $3", True, "contact"), ("@", " @ ", True, "contact"),
        (r"@.*", " @ ", False, "contact"), (r"^([^@]+)@([A-Za-z0-9-]+).*", "$1 @ $2", False, "contact"), (r"^([^@]+)@([A-Za-z0-9-]+).*", "$1@$2", False, "contact"), (r"^([^@]+)@([A-Za-z0-9-]+).*", "$1 (at) $2", False, "contact"),
    ),
    "phone": (
        (r"^\+[0-9]{1,3} ", "", True, "number"), (r"^\+[0-9]{1,3} \(?([0-9]+)\)? ?([0-9]+)[- ]([0-9]+)", "$1-$2-$3", True, "number"), (r"^\+[0-9]{1,3} \(?([0-9]+)\)? ?([0-9]+)[- ]([0-9]+)", "$1.$2.$3", True, "number"),
        (r"^\+[0-9]{1,3} \(?([0-9]+)\)? ?([0-9]+)[- ]([0-9]+)", "$1 $2 $3", True, "number"),
        (r"^\D*([0-9])[^0-9]*([0-9])\D*([0-9])\D*([0-9]).*", "20$1$2-0$3-1$4", False, "number"), (r"[^0-9]", "", False, "number"), (r"^\D*([0-9])\D*([0-9])\D*([0-9])\D*([0-9]).*", "$1.$2.$3$4", False, "dotted"),
    ),
    "card": ((r"([0-9]{4})[ -]?(?=[0-9])", "$1.", True, "number"), (r"([0-9]{4})[ -]?(?=[0-9])", "$1  ", True, "number"), (r"^([0-9]{4}).*?([0-9]{4})$", "$1$2", False, "number"), (r"^([0-9])(.*)$", "$2$1", False, "number"), (r"^([0-9]{4}).*?([0-9]{2})([0-9]{2})$", "$1/$2/$3 $1", False, "number")),
    "ip": ((r"\.", "[.]", True, "dotted"), (r"\.", " [dot] ", True, "dotted"), (r"\.", "(dot)", True, "dotted"), (r"\.[0-9]+$", "", False, "dotted"), (r"^[0-9]+", "$0.$0", False, "dotted"), (r"^[0-9]+\.", "9$0", False, "dotted")),
}
CONTEXT = 24
RECALL = 0.98
GRID = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: The threshold that few held-out rows are drawn towards, and how many rows it counts as.
PRIOR, PRIOR_ROWS = 0.6, 20
UNLABELLED = {"secret": 0.5, "number": 0.1, "contact": 0.1, "dotted": 0.1}
LEAF_WEIGHT = 0.05

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def located(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost matches of pattern that don't overlap, in order: structs of start, end, value, before and after (the text between this match
    and its neighbours)."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"])
        return F.struct((start + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate(F.arrays_zip(gaps.alias("gaps"), found.alias("found")), zero, step, lambda acc: acc["starts"])
    rows = F.transform(
        F.arrays_zip(found.alias("found"), F.slice(starts, 1, F.size(found)).alias("starts"), F.slice(gaps, 1, F.size(found)).alias("before"), F.slice(gaps, 2, F.size(found) + 1).alias("after")),
        lambda x: F.struct(x["starts"].alias("start"), (x["starts"] + F.length(x["found"])).alias("end"), x["found"].alias("value"), F.right(x["before"], F.lit(CONTEXT)).alias("before"), F.left(x["after"], F.lit(CONTEXT)).alias("after")),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(text.rlike(needs), rows).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def proven(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    size = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return size.between(14, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: proven(kind, x["value"])


def _ranked(kind: str, *fields: str) -> Callable[[Column], Column]:
    """From a located match to a struct of start, rank and the fields."""
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), *[x[f].alias(f) for f in fields])


def base_spans(text: Column) -> Column:
    """The base spans of a text: structs of start, rank (place in KINDS) and end, sorted."""
    each = []
    for kind in PATTERNS:
        passed = F.filter(located(text, PATTERNS[kind], NEEDS[kind]), _passes(kind))
        each.append(F.transform(passed, _ranked(kind, "end")))
    return F.array_sort(F.concat(*each)).cast(_SPAN)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == KINDS.index(kind))).cast("long")


#: What the trees of each generator see: format, and the context at the end of it. How a secret's label is found (the key that it is assigned to, and with it what
#: stands around it) is not among it.
AROUND = ("quoted", "after_space", "before_space", "contact_word")
SEEN = {
    "secret": ("length", "digit_share", "hex_share", "n_upper", "n_marks", "n_dashes"),
    "number": ("n_digits", "n_runs", "longest_digits", "n_dots", "n_dashes", "n_spaces", "has_plus", "has_paren", "grouped", "luhn", *AROUND),
    "contact": ("domain_dots", "has_at", "spelt_at", "spelt_dot", "n_spaces", *AROUND),
    "dotted": ("n_runs", "in_byte_range", "n_dots", "spelt_dot", *AROUND),
}
FEATURES = tuple(dict.fromkeys(f for seen in SEEN.values() for f in seen))


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def _described(each: DataFrame) -> DataFrame:
    """each (with rank, value, before, after) with its features in columns f_*, and assigned: whether it is assigned to a key that names a secret."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    size = F.length(v).cast("double")
    plain = F.regexp_replace(v, r"\[\.\]| ?[(\[]dot[)\]] ?", ".")
    features = {
        "length": size, "n_digits": _count(v, "[0-9]"), "digit_share": _count(v, "[0-9]") / size, "hex_share": _count(v, "[0-9a-f]") / size,
        "n_upper": _count(v, "[A-Z]"), "n_marks": _count(v, r"[^\p{L}0-9]"), "n_spaces": _count(v, " "), "n_dots": _count(plain, r"\."), "n_dashes": _count(v, "-"), "n_runs": _count(v, "[0-9]+"),
        "longest_digits": F.array_max(F.transform(F.split(v, "[^0-9]+"), F.length)), "domain_dots": _count(F.regexp_extract(plain, r"(?:@|[(\[]at[)\]])(.*)$", 1), r"\."),
        "has_at": v.contains("@"), "spelt_at": v.rlike(r"[(\[]at[)\]]"), "spelt_dot": v.rlike(r"\[\.\]|[(\[]dot[)\]]"), "has_plus": v.startswith("+"), "has_paren": v.contains("("),
        "grouped": v.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"), "luhn": F.call_function("luhn_check", digits(v)), "in_byte_range": proven("ip", plain),
        "quoted": before.rlike("[\"']$"), "after_space": after.rlike(r"^\s"), "before_space": before.rlike(r"\s$"), "contact_word": before.rlike(r"(?i)\b(?:tel|phone|call|fax|mobile|mail|contact|reach|write)\W*\w*\W*$"),
    }
    columns = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in features.items()]
    assigned = (F.col("rank") == KINDS.index("secret")) & before.rlike(KEYWORD + r"\W{0,6}$") & before.rlike(r"[=:]\s?[\"']?$")
    return each.select("doc_id", "text_hash", "rank", "start", "end", "value", "before", "after", "proof", assigned.alias("assigned"), *columns)


def candidates(docs: DataFrame, with_base: bool = True) -> DataFrame:
    """doc_id, text_hash, rank, start, end, value, before, after, proof (it overlaps a base span), assigned and the features of each span that a generator proposes;
    with_base also of the base spans, as ranks of their own kinds."""
    text = text_of()
    fields = ("end", "value", "before", "after")
    proposals = [F.transform(located(text, pattern, needs), _ranked(kind, *fields)) for kind, (pattern, needs) in GENERATORS.items()]
    found = [F.transform(F.filter(located(text, PATTERNS[kind], NEEDS[kind]), _passes(kind)), _ranked(kind, *fields)) for kind in PATTERNS]
    base = F.when(text.rlike("[0-9@]"), F.concat(*found))
    rows = row_key(docs).select("doc_id", "text_hash", base.alias("base"), F.concat(*proposals).alias("all"))
    rows = rows.withColumn("base", F.coalesce("base", F.slice("all", 1, 0)))
    every = F.concat("base", "all") if with_base else F.col("all")
    each = rows.select("doc_id", "text_hash", "base", F.explode(every).alias("x")).select("doc_id", "text_hash", "base", "x.*")
    on_base = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return _described(each.withColumn("proof", on_base))


def _rewritten(base: DataFrame) -> DataFrame:
    """The candidates in the variants of base spans (value, before, after, rank), with their label: a variant's own, if the generator meant for it proposes
    something in its place; what else is proposed there isn't known and left out."""
    forms = []
    for kind, variants in VARIANTS.items():
        for pattern, replacement, holds, generator in variants:
            value = F.regexp_replace("value", pattern, replacement)
            forms.append(F.when(F.col("rank") == KINDS.index(kind), F.struct(value.alias("variant"), F.lit(float(holds)).alias("label"), F.lit(KINDS.index(generator)).alias("meant"))))
    each = base.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "before", "after", "value", F.explode(F.filter(F.array(*forms), lambda x: x.isNotNull())).alias("v"))
    changed = each.where(F.col("v.variant") != F.col("value"))
    key = F.struct(F.col("_hash").alias("hash"), F.length("before").alias("low"), (F.length("before") + F.length("v.variant")).alias("high"), F.col("v.label").alias("label"), F.col("v.meant").alias("meant"))
    texts = changed.select(key.alias("doc_id"), F.concat("before", "v.variant", "after").alias("text"))
    found = candidates(texts, with_base=False).where((F.col("rank") == F.col("doc_id.meant")) & (F.col("start") < F.col("doc_id.high")) & (F.col("end") > F.col("doc_id.low")))
    return found.where(~F.col("proof")).select(F.col("doc_id.hash").alias("text_hash"), "rank", F.col("doc_id.label").alias("label"), *[f"f_{n}" for n in FEATURES])


def _assembled(rows: DataFrame, rank: int) -> DataFrame:
    """The rows of one generator with the features that its trees see."""
    return VectorAssembler(inputCols=[f"f_{n}" for n in SEEN[KINDS[rank]]], outputCol="features").transform(rows.where(F.col("rank") == rank))


def _scored(model: GBTClassificationModel, assembled: DataFrame) -> DataFrame:
    return model.transform(assembled).withColumn("p", vector_to_array("probability")[1])


def _once(rows: DataFrame) -> DataFrame:
    """The different rows (by text, place and rank): equal texts count once."""
    return rows.dropDuplicates(["text_hash", "rank", "start", "end"])


def labelled(found: DataFrame) -> DataFrame:
    """text_hash, rank, label, weight and features of all natural candidates, and of the variants of all base spans."""
    natural = _once(found.where((F.col("rank") >= len(PATTERNS)) & ~F.col("proof")))
    rewritten = _rewritten(_once(found.where(F.col("rank") < len(PATTERNS))))
    label = F.when(F.col("assigned"), 1.0).alias("label")  # null: unlabelled
    rows = cut(natural.select("text_hash", "rank", label, *[f"f_{n}" for n in FEATURES]).unionByName(rewritten))
    weight = F.lit(1.0)
    for r in rows.groupBy("rank").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label").isNull()).alias("open")).collect():  # a row for each generator
        own = min(1.0, UNLABELLED[KINDS[r["rank"]]] * r["yes"] / max(1, r["open"]))
        weight = F.when(F.col("label").isNull() & (F.col("rank") == r["rank"]), own).otherwise(weight)
    return rows.withColumns({"weight": weight, "label": F.coalesce("label", F.lit(0.0))}).where("weight > 0")


def fit(found: DataFrame, recall: float = RECALL) -> dict[int, tuple[GBTClassificationModel, float]]:
    """For each generator (by rank) its boosted trees and threshold; generators without candidates of both classes have none."""
    rows = cut(labelled(found).withColumn("held_out", F.pmod(F.xxhash64(F.lit(5), "text_hash"), F.lit(3)) == 0).repartition("text_hash"))
    classes = {(r["rank"], r["label"]) for r in rows.where(~F.col("held_out")).select("rank", "label").distinct().collect()}
    fitted = {}
    for rank in sorted(r for r, label in classes if label == 1 and (r, 0.0) in classes):  # a fit for each generator
        own = _assembled(rows, rank)
        trees = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.4, minWeightFractionPerNode=LEAF_WEIGHT, seed=7, labelCol="label", featuresCol="features", weightCol="weight")
        model = trees.fit(own.where(~F.col("held_out")))
        scored = _scored(model, own.where("held_out"))
        row = scored.where("label = 1").agg(F.count("*").alias("n"), *[F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(GRID)]).first()
        n = row["n"]
        best = max((t for i, t in enumerate(GRID) if row[f"n{i}"] >= recall * n), default=GRID[0])
        fitted[rank] = (model, (n * best + PRIOR_ROWS * PRIOR) / (n + PRIOR_ROWS))
    return fitted


def spans_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, base and spans (base and added) of the documents with any."""
    found = cut(candidates(docs))
    is_base = F.col("rank") < len(PATTERNS)
    rows = found.where(is_base)
    for rank, (model, threshold) in fit(found, **options).items():
        rows = rows.unionByName(_scored(model, _assembled(found, rank)).where(F.col("p") >= threshold).select(*found.columns))
    span = F.struct("start", "rank", "end")
    each = rows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(is_base, span)).alias("base"), F.collect_set(F.when(~is_base, span)).alias("added"))
    covered = F.filter("added", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return each.select("doc_id", "text_hash", F.array_sort("base").cast(_SPAN).alias("base"), F.array_sort(F.concat("base", covered)).cast(_SPAN).alias("spans"))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, base and spans (base and added) for each row of docs: sorted structs of start, rank (in KINDS), end."""
    found = spans_of(docs, **options).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    rows = row_key(docs).select("doc_id", "text_hash")
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"]) & (rows["text_hash"] == found["found_hash"]), "left")
    none = F.array().cast(_SPAN)
    return both.select("doc_id", "text_hash", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """doc_id and redacted: the text with each stretch that spans cover replaced by its first span's kind in angle brackets (null: empty)."""
    found = cut(spans_of(docs, **options))
    order = Window.partitionBy("found_id", "found_hash").orderBy("start", "rank")
    each = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), F.explode("spans").alias("x")).select("found_id", "found_hash", "x.*")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = each.withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("stretch", F.sum("fresh").over(order))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    merged = grouped.groupBy("found_id", "found_hash", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "rank")).alias("first"))
    listed = merged.groupBy("found_id", "found_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.get(kinds, F.col("first.rank")).alias("kind")))).alias("cuts"))
    rows = row_key(docs)
    both = rows.join(listed, rows["doc_id"].eqNullSafe(listed["found_id"]) & (rows["text_hash"] == listed["found_hash"]), "left")
    # four bytes a character, so that a piece is found without counting through the text
    data = F.encode(text_of(), "UTF-32")
    piece = lambda low, high: F.decode(F.substring("data", 4 * low + 1, 4 * (high - low)), "UTF-32")
    before = lambda i: F.coalesce(F.get(F.col("cuts"), i - 1)["end"], F.lit(0))
    parts = F.transform("cuts", lambda x, i: F.concat(piece(before(i), x["start"]), F.lit("<"), x["kind"], F.lit(">")))
    rest = piece(F.element_at("cuts", -1)["end"], F.octet_length("data"))
    return both.withColumn("data", data).select("doc_id", F.when(F.col("cuts").isNull(), text_of()).otherwise(F.concat(F.array_join(parts, ""), rest)).alias("redacted"))
