"""Personal data: patterns for identifiers, and terms that give protected entities away, by corpus co-occurrence.

Built-in expressions only. The base finds e-mail addresses, IP addresses, card and phone
numbers. For each pattern a text falls into the matches and the gaps between them; sums of
their lengths are the spans, in code points, end exclusive.

Beyond the base, information-theoretic sanitisation (Sanchez and Batet): protected are the
values of the base and secrets, machine-made runs of letters and digits whose information alone
gives them away. An entity is one value, or what many values share: the domain of addresses, the
beginning of IP addresses, cards and phone numbers, and for secrets, of which no two are alike, that
there is one. A term is a word of letters outside the spans, anywhere in a document
that holds the entity. With n documents, n_e of them holding the entity, n_t the term and n_et
both,

    information of the entity   IC  = log2(n / n_e)
    what the term gives away    PMI = log2(n * n_et / (n_e * n_t))

What more than an eighth of all documents hold (an address in every footer, say) tells nobody apart and is
no entity. A term that gives away `GENERALISE` of an entity's information is replaced by the kind of
entity it points to, from `REMOVE` on it is removed, wherever it occurs. All counts are over
all documents.

However rare, a pair counts if chance doesn't explain it: Hoeffding's bound for meeting so
often in independent documents, times the number of different terms, must be at most `CHANCE`,
so that for each entity a wrong term is that unlikely. Near-copies of one text are one
witness: documents of an entity that share any of `SKETCH` least hashes of their runs of
`RUN` words. A single meeting has chance n_t / n, so a value of one document has terms of its own only where
a table has far fewer terms than documents; elsewhere all words of a document that occur once
meet it just as often as chance has it, and what counts is the value's domain or beginning.

An empty table gives no rows. Null and empty texts have no spans. Repeated rows get equal results and count as documents of
their own. A match that fails its check (parts, digits, Luhn) is dropped and not tried again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm.common import checkpoint, text_of, whole

# What is looked for. Runs are matched as wholes (possessively) and only from
# their beginning, or from the end of the match before, which finds the same as starting
# anywhere would, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
# What a text must hold for the pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}

TERM = r"\p{L}{3,}"
# Runs of 32 and more letters and digits, four of each at least.
SECRET = r"(?<![A-Za-z0-9_])(?=(?:[A-Za-z_]*+[0-9]){4})(?=(?:[0-9_]*+[A-Za-z]){4})[A-Za-z0-9_]{32,}+"
GENERALISE = 0.8
REMOVE = 0.95
CHANCE = 0.05
# Bits of an entity that is worth protecting: it may be in an eighth of the documents at most.
LEAST_INFORMATION = 3.0
SKETCH = 8
RUN = 8
BROADCAST_TERMS = 200_000
_BLOCK = 64
_SPANS = "array<struct<start: int, stop: int, value: string>>"


def _nothing(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def _each_before(values: Column, levels: int = 2) -> Column:
    """For each of some whole numbers the sum of those before it.

    A running array is copied at each step, so it is kept for a block at a time: sums within
    blocks, then, by the same way, those of the blocks.
    """

    def running(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("sum"), _nothing("array<int>").alias("all")),
            lambda done, v: F.struct((done["sum"] + v).alias("sum"), F.array_append(done["all"], done["sum"]).alias("all")),
            lambda done: done["all"],
        )

    def by_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y))
        shifted = F.zip_with(
            F.transform(blocks, running), _each_before(sums, levels - 1), lambda part, first: F.transform(part, lambda v: v + first)
        )
        return F.flatten(shifted)

    def cut(whole_array: Column) -> Column:
        last = F.floor((F.size(whole_array) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(whole_array, k * _BLOCK + 1, F.lit(_BLOCK)))

    if not levels:
        return running(values)
    return _once(values, lambda v: F.when(F.size(v) > _BLOCK, _once(cut(v), by_blocks)).otherwise(running(v)))


def spans_of(text: Column, pattern: Column) -> Column:
    """`(start, stop, value)` of all matches, in order; time grows in proportion to the text and its matches."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def located(pairs: Column) -> Column:
        before = _each_before(F.transform(pairs, lambda p: p["gap"] + F.length(p["value"])))
        return F.zip_with(
            pairs,
            before,
            lambda p, b: F.struct(
                (b + p["gap"]).alias("start"), (b + p["gap"] + F.length(p["value"])).alias("stop"), p["value"].alias("value")
            ),
        )

    def paired(found: Column) -> Column:
        # One more gap than matches; the last is not needed.
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
        return F.when(F.size(found) > 0, _once(pairs, located)).otherwise(_nothing())

    return _once(matches, paired)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others sum up to a multiple of ten."""
    reverse = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(reverse))

    def counted(k: Column) -> Column:
        digit = F.substr(reverse, k, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(k % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.transform(places, counted), F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, span: Column) -> Column:
    value = span["value"]
    digits = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return digits.between(14, 19) & F.when(digits.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Struct with the checked spans of each kind."""
    patterns = dict(zip(KINDS, [EMAIL, IP, CARD, PHONE], strict=True))
    found = []
    for kind, pattern in patterns.items():
        spans = F.filter(spans_of(text, F.lit(pattern)), partial(_passes, kind))
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        found.append(F.when(hint, spans).otherwise(_nothing()).alias(kind))
    # Worked out once, however many of its fields are used.
    return _once(F.struct(*found), lambda spans: spans)


def listed(spans: dict[str, Column]) -> Column:
    """All spans as `(start, rank, kind, stop)`, by start, then kind as listed."""

    def ranked(k: int, kind: str, s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))

    parts = [F.transform(column, partial(ranked, k, kind)) for k, (kind, column) in enumerate(spans.items())]
    return F.array_sort(F.concat(*parts))


def written(ordered: Column) -> Column:
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def secret_spans(text: Column) -> Column:
    return F.when(text.rlike("[A-Za-z0-9_]{32}"), spans_of(text, F.lit(SECRET))).otherwise(_nothing())


def with_base(docs: DataFrame) -> DataFrame:
    """`row`, `text` (null as empty), `base`, the spans by kind, and `secrets`."""
    text = F.col("text")
    found = docs.select(whole(), text_of("text").alias("text"))
    return found.withColumns({"base": base_spans(text), "secrets": _once(secret_spans(text), lambda s: s)})


def _shared(kind: str, value: Column) -> Column:
    """What an entity has in common with others: domain, network, issuer, area."""
    if kind == "email":
        return F.concat(F.lit("@"), F.substring_index(value, "@", -1))
    if kind == "ip":
        return F.concat(F.substring_index(value, ".", 2), F.lit(".*"))
    return F.concat(F.left(_digits(value), F.lit(6 if kind == "card" else 4)), F.lit("*"))


def _entities() -> Column:
    """The different entities of a row of `with_base`, as kind and value, or kind and what values share."""

    def named(kind: str, s: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.lower(s["value"]))

    def pooled(kind: str, s: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), _shared(kind, F.lower(s["value"])))

    found = [F.transform(F.col(f"base.{kind}"), partial(f, kind)) for kind in KINDS for f in (named, pooled)]
    secret = F.when(F.size("secrets") > 0, F.array(F.lit("secret:any"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*found, secret))


def _sketch(text: Column) -> Column:
    """`SKETCH` least hashes of the runs of `RUN` words, each by a hash function of its own."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - RUN + 1, F.lit(1)))
        return F.transform(starts, lambda k: F.xxhash64(F.slice(words, k, F.lit(RUN))))

    def least(hashes: Column) -> Column:
        places = F.sequence(F.lit(1), F.lit(SKETCH))
        return F.transform(places, lambda k: F.array_min(F.transform(hashes, lambda r: F.xxhash64(r, k))))

    return _once(_once(F.split(F.lower(text), r"\s+"), runs), least)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, also where inner functions use it at each element."""
    return F.transform(F.array(value), use)[0]


def _witnesses(holding: DataFrame, entities: DataFrame) -> DataFrame:
    """`(entity, doc, witness)`: near-copies among the documents of an entity share a witness."""
    held = holding.select("doc", "sketch", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity")
    marks = held.select("entity", "doc", F.posexplode("sketch").alias("place", "mark"))
    firsts = marks.groupBy("entity", "place", "mark").agg(F.min("doc").alias("first"))
    joined = marks.join(firsts, ["entity", "place", "mark"])
    return joined.groupBy("entity", "doc").agg(F.min("first").alias("witness"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """`(term, kind, disclosure)`: terms that give away a protected entity, with the most that each gives away."""
    based = with_base(docs).withColumn("entities", _entities()).where(F.size("entities") > 0)
    bare = replaced(F.col("text"), "base", None, " ")
    holding = based.select(
        F.monotonically_increasing_id().alias("doc"), "entities", _sketch(F.col("text")).alias("sketch"), _terms(bare).alias("terms")
    )
    holding = checkpoint(holding)
    if holding.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, kind string, disclosure double")
    n = docs.count()
    words = docs.select(F.explode(_terms(text_of("text"))).alias("term"))
    n_terms = words.agg(F.approx_count_distinct("term", 0.01)).first()[0]
    least = log(max(n_terms, 1) / CHANCE)
    entities = holding.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # The most that an entity's documents can prove: a term in each of its witnesses and nowhere else.
    entities = checkpoint(entities.where((_information(n) >= LEAST_INFORMATION) & (F.col("n_e") * _information(n) * log(2) >= least)))
    witnesses = checkpoint(_witnesses(holding, entities))
    proven = witnesses.groupBy("entity").agg(F.count_distinct("witness").alias("most"))
    entities = entities.join(proven, "entity").where(F.col("most") * _information(n) * log(2) >= least).select("entity", "n_e")
    entities = checkpoint(entities)
    around = witnesses.join(entities, "entity").join(holding.select("doc", "terms"), "doc")
    met = around.select("entity", "n_e", "witness", F.explode("terms").alias("term")).groupBy("entity", "n_e", "term")
    met = met.agg(F.count("*").alias("n_et"), F.count_distinct("witness").alias("witnesses"))
    near_any = holding.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    # A term occurs at least where there is any entity, so this is the most it can give away and prove.
    met = met.join(near_any, "term").where(_gives_away(n) & (_evidence(n) >= least)).drop("n_t")
    met = checkpoint(met)
    terms = _few(met.select("term").distinct())
    seen = words.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    given = met.join(seen, "term").where(_gives_away(n) & (_evidence(n) >= least))
    given = given.withColumn("disclosure", _told(n, F.col("n_t")) / _information(n))
    strongest = F.max(F.struct("disclosure", F.substring_index("entity", ":", 1).alias("kind"))).alias("most")
    return given.groupBy("term").agg(strongest).select("term", "most.kind", "most.disclosure")


def _gives_away(n: int) -> Column:
    return _told(n, F.col("n_t")) >= GENERALISE * _information(n)


def _evidence(n: int) -> Column:
    """Minus the natural logarithm of the bound on the chance to meet in `witnesses` documents or more.

    Hoeffding (1963) for drawing without replacement: exp(-m KL(k / m, share)). Either side may be
    taken for the draw, and the better bound holds.
    """
    k = F.col("witnesses").cast("double")

    def bound(drawn: Column, others: Column) -> Column:
        got, share = k / drawn, others / F.lit(float(max(n, 1)))
        rest = F.when(got < 1, (1 - got) * F.log((1 - got) / (1 - share))).otherwise(0.0)
        return F.when(share >= 1, 0.0).when(got > share, drawn * (got * F.log(got / share) + rest)).otherwise(0.0)

    return F.greatest(bound(F.col("n_e"), F.col("n_t")), bound(F.col("n_t"), F.col("n_e")))


def _told(n: int, n_term: Column) -> Column:
    return F.log2(F.lit(float(max(n, 1))) * F.col("n_et") / (F.col("n_e") * n_term))


def _information(n: int) -> Column:
    return F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _few(terms: DataFrame) -> DataFrame:
    """Sent to all executors while there are at most `BROADCAST_TERMS`, shuffled beyond."""
    terms = checkpoint(terms)
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def found_spans(docs: DataFrame) -> DataFrame:
    """`row`, `text`, `base` and `terms`, the spans of disclosing terms, each with what replaces it in `value`."""
    terms = checkpoint(disclosing_terms(docs))
    based = with_base(docs)
    n = terms.count()
    if not n:
        return based.withColumn("terms", _nothing())
    known = F.broadcast(terms) if n <= BROADCAST_TERMS else terms
    text = text_of("text")
    # Joined before anything is shuffled: of all words only the hits are left.
    hits = docs.select(F.sha2(text, 256).alias("digest"), F.explode(_terms(text)).alias("term")).join(known, "term")
    hits = hits.groupBy("digest", "term").agg(F.first("kind").alias("kind"), F.first("disclosure").alias("disclosure"))
    instead = F.when(F.col("disclosure") >= REMOVE, "").otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit(" CONTEXT]")))
    of_text = checkpoint(hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", instead))).alias("hits")))
    of_text = F.broadcast(of_text) if of_text.count() <= BROADCAST_TERMS else of_text
    joined = based.withColumn("digest", F.sha2("text", 256)).join(of_text, "digest", "left")
    # Terms are letters only, so they need no quoting.
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("hits"), "|"), F.lit(r")(?!\p{L})"))
    spans = F.transform(
        spans_of(F.col("text"), pattern),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.coalesce(F.try_element_at("hits", F.lower(s["value"])), F.lit("")).alias("value"),
        ),
    )
    return joined.withColumn("terms", F.when(F.col("hits").isNotNull(), spans).otherwise(_nothing())).drop("digest", "hits")


def replaced(text: Column, base: str, terms: str | None, by: str | None = None) -> Column:
    """Text with each span replaced, those of the base and secrets by their kind or `by`; of spans that overlap, the first stands for all."""

    def named(kind: str, s: Column) -> Column:
        value = f"[{kind.upper()}]" if by is None else by
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(value).alias("value"))

    parts = [F.transform(F.col(f"{base}.{kind}"), partial(named, kind)) for kind in KINDS]
    parts.append(F.transform(F.col("secrets"), partial(named, "secret")))
    spans = F.array_sort(F.concat(*parts, _nothing() if terms is None else F.col(terms)))
    pieces = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda done, s: F.when(
            s["start"] >= done["at"],
            F.struct(
                s["stop"].alias("at"),
                F.concat(done["out"], F.array(F.substr(text, done["at"] + 1, s["start"] - done["at"]), s["value"])).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(done["at"], s["stop"]).alias("at"), done["out"].alias("out"))),
        lambda done: F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, pieces).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with texts replaced where they hold spans, and `n_chars` where there is such a column."""
    found = found_spans(docs)
    changed = found.withColumn("clean", replaced(F.col("text"), "base", "terms"))
    touched = F.col("clean") != F.col("text")
    columns = []
    for name, kind in docs.dtypes:
        own = F.col(f"row.`{name}`")
        if name == "text":
            own = F.when(touched, F.col("clean")).otherwise(own)
        elif name == "n_chars":
            own = F.when(touched, F.length("clean").cast(kind)).otherwise(own)
        columns.append(own.alias(name))
    return changed.select(*columns)


def spans_report(docs: DataFrame) -> DataFrame:
    """`row`, counts by kind, a digest of the base spans, all spans as text, and whether there are any."""
    found = found_spans(docs)
    base = {k: F.col(f"base.{k}") for k in KINDS}
    return found.select(
        "row",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()],
        F.sha2(written(listed(base)), 256).alias("base_sha256"),
        written(listed(base | {"secret": F.col("secrets"), "term": F.col("terms")})).alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"),
        F.size("terms").cast("long").alias("n_term"),
        (sum((F.size(c) for c in base.values()), F.size("secrets") + F.size("terms")) > 0).alias("is_private"),
    )
