"""Personal data: candidate spans by patterns, boosted trees choose, DataFrame functions only.

Generators propose spans: the four base patterns (their valid matches are always redacted) and looser
ones, which overlap them. Boosted trees (pyspark.ml) score every candidate by its format and context.
They learn from generated sentences (``examples``): personal data in several spellings, and what looks
like it but is an order number, a version, a serial number or plain words. Thresholds are set for each
kind where precision is high enough on generated sentences that the trees have not seen and on all base
matches of the table, valid ones against those that fail their kind's check. A loose span is redacted if
its score reaches its kind's threshold and no base span overlaps it; what a kind's own check refuses
(Luhn, octets) never is.

Everything about one text stays in its row: no shuffle, no key. Positions are code points: the texts
between the matches give the starts, summed in blocks of ``BLOCK`` matches so that a text with many
matches costs little more than its length.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 6000  # generated sentences, a third of them for the thresholds
SHORT = 7  # shorter matches that fail their check look like nothing and are not counted
BLOCK = 256
PRECISION = 0.98
GRID = tuple(x / 20 for x in range(10, 20))

# The base patterns, written so that no text makes them slow: a match begins where a run
# begins or where the match before ended, and runs are never given back. The last column is what a text
# must hold for the pattern to be tried at all.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++", "at"),
    "ip": (r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])", "[.]"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[.\x20-][0-9]{4}){3}(?![0-9])", "[0-9]{4}[.\\x20-][0-9]{4}"),
    "phone": (r"(?<![0-9+])\(?[0-9]{3}\)?[.\x20-][0-9]{3}[.\x20-][0-9]{4}(?![0-9])", "[0-9]{3}[.\\x20-][0-9]{4}"),
}
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
CONTEXT = ("mail|contact|write|@", "tel|phone|call|fax|mobile", "card|visa|pay|account", "ip|host|server|addr", "order|ticket|version|release|serial|part|isbn|invoice|ref|model|sku|no[.]|#|score|section|build|item|lot")
PLAIN = {"@", "+", "at", "[.]"}
FEATURES = ("kind", "size", "digits", "spaces", "dots", "dashes", "brackets", "letters", "plus", "groups", "after_word", "before_word", "at_end", "at_start", *(f"context{i}" for i in range(len(CONTEXT))))


def _may(need: str) -> Column:
    """A cheap test that spares most texts the pattern."""
    return F.col("text").contains(need) if need in PLAIN else F.col("text").rlike(need)


def _matches(df: DataFrame, name: str, pattern: str, need: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.withColumn(f"{name}_m", F.when(_may(need), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)).withColumn(
        f"{name}_p", F.when(F.size(f"{name}_m") > 0, F.split("text", pattern, -1)).otherwise(none)
    )


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("double")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return F.translate(text, "[]", "").rlike(IP_VALID)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _placed(name: str, kind: str, base: bool) -> Column:
    """Matches as structs (start, kind, end, base, failing, text, before, after).

    ``base``: a base pattern's valid match. ``failing``: a match that its kind's check refuses.
    """
    m, p = F.col(f"{name}_m"), F.col(f"{name}_p")

    def item(i: Column) -> Column:
        t = F.get(m, i)
        return F.struct(t.alias("t"), F.length(F.get(p, i)).alias("gap"), F.substring(F.get(p, i), -16, 16).alias("before"), F.substring(F.get(p, i + 1), 1, 8).alias("after"))

    items = F.transform(F.sequence(F.lit(0), F.size(m) - 1), item)
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(m) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,failing:boolean,text:string,before:string,after:string>>")
    k = F.lit(KINDS.index(kind))

    def within(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s = acc["pos"] + x["gap"]
            e = s + F.length(x["t"])
            one = F.struct(
                s.alias("start"), k.alias("kind"), e.alias("end"), (_valid(kind, x["t"]) if base else F.lit(False)).alias("base"), (~_valid(kind, x["t"]) if base or kind in ("card", "ip") else F.lit(False)).alias("failing"), x["t"].alias("text"), x["before"].alias("before"), x["after"].alias("after")
            )
            return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(start.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

    length = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["t"]))
    sums = F.transform(blocks, length)
    starts = F.transform(blocks, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    one_block = within(items, F.lit(0))
    many = F.flatten(F.zip_with(blocks, starts, within))
    return F.when(F.size(m) == 0, none).when(F.size(m) <= BLOCK, one_block).otherwise(many)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: every generator's spans in the whole text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = []
    for group, patterns in (("b", BASE), ("l", LOOSE)):
        for kind, (pattern, need) in patterns.items():
            names.append((f"{group}_{kind}", kind, group == "b"))
            df = _matches(df, f"{group}_{kind}", pattern, need)
    df = df.drop("text")
    return df.select("doc_id", F.concat(*[_placed(n, k, b) for n, k, b in names]).alias("found"))


def _features(x: Column) -> list[Column]:
    t, before, after = x["text"], x["before"], x["after"]
    low = F.lower(before)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        x["kind"].cast("double"), F.length(t).cast("double"), _count(t, "[0-9]"), _count(t, "\\x20"), _count(t, "\\."), _count(t, "-"), _count(t, "[()\\[\\]]"), _count(t, "[A-Za-z]"),
        flag(F.startswith(t, F.lit("+"))), F.size(F.split(t, "[^0-9A-Za-z]+", -1)).cast("double"), flag(after.rlike("^[A-Za-z0-9]")), flag(before.rlike("[A-Za-z0-9]$")), flag(after == ""), flag(before == ""),
        *[flag(low.rlike(c)) for c in CONTEXT],
    ]


# The words of the generated sentences.
_BEFORE = {
    "email": ("mail me: ", "please contact ", "write to ", "my e-mail is ", "send mail to "),
    "ip": ("the host ", "server at ", "my ip is ", "address ", "logged in from host "),
    "card": ("my card ", "visa ", "paid with card ", "account ", "pay by card: "),
    "phone": ("call me on ", "tel. ", "phone: ", "fax ", "my mobile is ", "telephone "),
}
_PLAIN = ("reach me at ", "you find me under ", "Smith, ", "it is ", "", "just use ", "thanks! ", "yours, Ann ")
_OTHER = ("order ", "ticket ", "version ", "serial ", "part number ", "ISBN ", "invoice ", "ref. ", "model ", "SKU ", "release ", "item no. ", "lot # ", "section ", "build ", "score ")
_AFTER = (" today", ".", ", thanks", "", " and so on", "!", " (work)")
_NAMES = ("ann", "bob.miller", "c_lee", "d-ray77", "eva.k", "info", "sales.team", "j.r.doe")
_HOSTS = ("example", "my-mail", "uni", "post9", "shop24", "acme")
_ENDS = ("com", "org", "net", "de", "co")
_WORDS = ("look", "stay", "meet", "arrive", "laughing", "begins", "sold", "works", "priced")
_PLACES = ("noon", "home", "once", "the", "3", "room12", "them", "5")
_NEXT = ("We", "Then", "30", "It", "50", "And", "She")


def examples(spark: SparkSession, number: int = EXAMPLES) -> DataFrame:
    """(doc_id, text, kind, label): generated sentences with one candidate each, the same ones every time."""
    salt = iter(range(10**6))
    any_of = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("doc_id", F.lit(next(salt))), F.lit(len(xs))) + 1).cast("int"))
    chance = lambda p: F.pmod(F.xxhash64("doc_id", F.lit(next(salt))), F.lit(100)) < p
    number_below = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(next(salt))), F.lit(n)).cast("string")
    digits = lambda n: F.lpad(number_below(10**n), n, "0")
    def joined(sep: Column | str, parts: list[Column]) -> Column:
        sep = F.lit(sep) if isinstance(sep, str) else sep
        return F.concat(parts[0], *[x for p in parts[1:] for x in (sep, p)])

    at, dot = any_of(("(at)", " (at) ", "[at]", " [at] ")), any_of((".", " (dot) ", "[dot]", ".", "(dot)"))
    email = F.when(chance(30), F.concat(any_of(_NAMES), F.lit("@"), any_of(_HOSTS), F.lit("."), any_of(_ENDS))).otherwise(F.concat(any_of(_NAMES), at, any_of(_HOSTS), dot, any_of(_ENDS)))
    words = F.concat(any_of(_WORDS), any_of((" (at) ", " [at] ")), any_of(_PLACES), any_of((".", ". ")), any_of(_NEXT))
    octets = lambda n, sep: joined(sep, [number_below(n) for _ in range(4)])
    ip = F.when(chance(30), octets(256, ".")).otherwise(octets(256, "[.]"))
    no_ip = F.when(chance(50), octets(999, ".")).otherwise(octets(12, "[.]"))
    fifteen = digits(15)
    # the last digit by the Luhn rule: nine times the sum of all, the first doubled
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda t, i: t + F.when(i % 2 == 0, F.substring(fifteen, i, F.lit(1)).cast("int")).otherwise(_doubled(F.substring(fifteen, i, F.lit(1)).cast("int"))))
    sixteen = F.concat(fifteen, F.pmod(total * 9, F.lit(10)).cast("string"))
    in_fours = lambda x, sep: joined(sep, [F.substring(x, i, 4) for i in (1, 5, 9, 13)])
    card = F.when(chance(30), sixteen).otherwise(F.when(chance(70), in_fours(sixteen, ".")).otherwise(in_fours(sixteen, "-")))
    no_card = F.when(chance(40), in_fours(digits(16), "-")).otherwise(in_fours(sixteen, "."))
    local = F.when(chance(30), F.concat(F.lit("("), digits(3), F.lit(") "), digits(3), F.lit("-"), digits(4))).otherwise(joined(any_of(("-", ".", " ")), [digits(3), digits(3), digits(4)]))
    phone = F.when(chance(25), F.concat(F.lit("+"), number_below(90), F.lit(" "), digits(3), F.lit(" "), digits(7))).otherwise(local)
    no_phone = F.when(chance(25), F.concat(F.lit("+"), digits(2), F.lit(" "), digits(3))).otherwise(joined(any_of(("-", ".", " ")), [digits(3), digits(3), digits(4)]))
    df = spark.range(0, number, 1, 4).select(F.col("id").alias("doc_id")).withColumns(_planted())
    good, bad, before = F.lit(""), F.lit(""), F.lit("")
    for i, (kind, yes, no) in enumerate((("email", email, words), ("ip", ip, no_ip), ("card", card, no_card), ("phone", phone, no_phone))):
        mine = F.col("kind") == i
        good, bad, before = F.when(mine, yes).otherwise(good), F.when(mine, no).otherwise(bad), F.when(mine, any_of(_BEFORE[kind])).otherwise(before)
    other = F.when((F.col("kind") == 0) & chance(70), any_of(_PLAIN)).otherwise(any_of(_OTHER))
    yes, no = F.concat(F.when(chance(60), before).otherwise(any_of(_PLAIN)), good), F.concat(other, bad)
    return df.withColumn("text", F.concat(F.when(F.col("label") == 1, yes).otherwise(no), any_of(_AFTER)))


def _planted() -> dict[str, Column]:
    """Kind and label of a generated sentence, from its number."""
    return {"kind": (F.col("doc_id") % len(KINDS)).cast("int"), "label": F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(2)).cast("int")}


def _doubled(v: Column) -> Column:
    return 2 * v - F.when(v > 4, 9).otherwise(0)


def tree_rules(model: GBTClassificationModel) -> list[tuple[float, object]]:
    """(weight, tree) with a tree as a number or (feature, threshold, left, right)."""

    def node(n) -> object:
        if n.getClass().getSimpleName() == "LeafNode":
            return float(n.prediction())
        split = n.split()
        return int(split.featureIndex()), float(split.threshold()), node(n.leftChild()), node(n.rightChild())

    return [(weight, node(tree._call_java("rootNode"))) for weight, tree in zip(model.treeWeights, model.trees)]


def score(rules: list[tuple[float, object]], features: list[Column]) -> Column:
    """The trees' probability; the features are computed once, as an array that the trees look into."""

    def walk(tree: object, weight: float, x: Column) -> Column:
        if isinstance(tree, float):
            return F.lit(weight * tree)
        j, t, left, right = tree
        return F.when(x[j] <= t, walk(left, weight, x)).otherwise(walk(right, weight, x))

    def total(x: Column) -> Column:
        terms = F.array(*[walk(tree, float(weight), x) for weight, tree in rules])
        return 1 / (1 + F.exp(-2 * F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)))

    return F.get(F.transform(F.array(F.array(*features)), total), F.lit(0))


def _least(scored: DataFrame) -> DataFrame:
    """(kind, t): the first step of the grid at which enough of what lies above it is labelled 1."""
    grid = scored.select("kind", "label", "score", F.explode(F.array(*[F.lit(g) for g in GRID])).alias("t")).where("score >= t")
    return grid.groupBy("kind", "t").agg(F.avg("label").alias("precision")).where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("t").alias("t"))


def _rows(found: DataFrame, label: Column) -> DataFrame:
    return found.select("kind", label.cast("double").alias("label"), *[c.alias(n) for c, n in zip(_features(F.col("x")), FEATURES) if n != "kind"], *(c for c in ("doc_id",) if c in found.columns))


def _scored(rows: DataFrame, rules: list) -> DataFrame:
    return rows.select("kind", "label", score(rules, [F.col(n).cast("double") for n in FEATURES]).alias("score"))


def learn(spark: SparkSession, number: int = EXAMPLES) -> tuple[list, dict[int, float]]:
    """(rules, threshold of each kind) from generated sentences alone: the same ones every time."""
    # written before explode(): inlined into the generator, the spans would be found again for each row
    found = written(candidates(examples(spark, number)), "examples").select("doc_id", F.explode("found").alias("x")).withColumns(_planted()).where("x.kind = kind")
    rows = written(_rows(found, F.col("label")), "candidates")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("doc_id % 3 <> 0")).orderBy("doc_id", *FEATURES).select("features", "label").coalesce(1)
    rules = tree_rules(GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(table))
    return rules, {r["kind"]: r["t"] for r in _least(_scored(rows.where("doc_id % 3 = 0"), rules)).collect()}  # at most four rows


_learned: list = []


def thresholds(found: DataFrame, rules: list, made: dict[int, float]) -> dict[int, float]:
    """The threshold of each kind: the larger of those by generated sentences and by all of the table.

    A kind without enough precision in the sentences has the last step of the grid; a kind that the
    table lacks has that by the sentences.
    """
    x = found.select(F.explode(F.filter("found", lambda x: x["base"] | x["failing"])).alias("x")).select(F.col("x.kind").alias("kind"), "x")
    here = {r["kind"]: r["t"] for r in _least(_scored(_rows(x, F.col("x.base")), rules)).collect()}  # at most four rows
    return {k: max(made.get(k, GRID[-1]), here.get(k, 0.0)) for k in range(len(KINDS))}


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of ``docs``.

    The counts and the digest are of the base spans; ``spans`` has those and the chosen loose ones.
    Null text counts as empty and has no span. Rows are independent: repeated rows, null ids and empty
    tables need no special case; other columns are ignored.
    """
    if not _learned:  # sentences and seed are fixed: once for each driver
        _learned.append(learn(docs.sparkSession))
    rules, made = _learned[0]
    found = candidates(docs).select("doc_id", F.filter("found", lambda x: ~x["failing"] | (F.length(x["text"]) >= SHORT)).alias("found"))
    found = written(found, "found")
    limits = thresholds(found, rules, made)
    df = found.select("doc_id", F.filter("found", lambda x: x["base"]).alias("base"), F.filter("found", lambda x: ~x["base"] & ~x["failing"]).alias("loose"))

    def above(x: Column) -> Column:
        limit = F.lit(None).cast("double")
        for kind, t in limits.items():
            limit = F.when(x["kind"] == kind, F.lit(t)).otherwise(limit)
        return (score(rules, _features(x)) >= limit) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    chosen = F.when(F.size("loose") > 0, F.filter("loose", above)).otherwise(F.filter("loose", lambda x: F.lit(False)))
    df = df.select("doc_id", "base", chosen.alias("more"))
    brief = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    df = df.select("doc_id", F.array_sort(brief("base")).alias("base"), F.array_sort(F.array_distinct(F.concat(brief("base"), brief("more")))).alias("every"))
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
