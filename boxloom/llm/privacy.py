"""Personal data: base patterns, and terms whose co-occurrence with protected entities discloses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import pack, shared

#: Kinds in their order, as Java patterns. Starts are tried only where an earlier match ended or no
#: run that could belong to the match began before, and runs are possessive, so long runs of digits
#: or letters take linear time; both find the same leftmost matches as the plain patterns.
KINDS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap needs of each kind, tested before the pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}

#: A further protected entity: keys and tokens, runs of letters and digits too long for a word.
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+"
NEEDS["secret"] = r"[A-Za-z0-9+/_-]{24}"
#: Kinds of spans in their order.
ORDER = (*KINDS, "secret", "term")

#: Different lines that a term and an entity must share before their co-occurrence says anything.
SUPPORT = 3
#: Shares of an entity's information content, above which a term is generalised or removed.
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"\p{L}+"
#: Texts with disclosing terms that are sent to every task at most; beyond that a join is shuffled.
BROADCAST_HITS = 400_000
#: Elements that a fold appends to one array; longer ones are folded in chunks.
CHUNK = 256


def _scan(items: Column, at: Column, kind: str, step) -> Column:
    """Fold ``items``: ``step(at, item)`` gives the next ``at`` and an array to add to the result.

    An array that grows is copied at each step, so a chunk's results are gathered by themselves and
    only chunks are added to the whole.
    """
    none = F.array().cast(f"array<{kind}>")
    # An array of one binds what is used twice, so that it is not evaluated for each use.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def inner(acc: Column, x: Column) -> Column:
        now, out = step(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

    def whole(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / CHUNK).cast("int"))
        chunks = F.transform(numbers, lambda c: F.slice(all_items, c * CHUNK + 1, CHUNK))
        start = F.struct(at.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(all_items) > 0, F.aggregate(chunks, start, outer, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return bound(items, whole)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits."""
    place = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(place, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(p, -3, 3).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _places(text: Column, pattern: Column) -> Column:
    """Every match with its code point range: matches and the pieces between them are laid end to end."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["p"])
        end = start + F.length(x["m"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))

    inner = F.filter(pairs, lambda x: x["m"].isNotNull())
    return _scan(inner, F.lit(0), "struct<start:int,end:int,m:string>", step)


def base_spans(text: Column, secrets: bool = False) -> Column:
    """Array of (start, order, end, kind, value) of the base patterns' valid matches, by start, then kind; and of ``secrets``."""
    found = []
    for order, (kind, pattern) in enumerate((KINDS | ({"secret": SECRET} if secrets else {})).items()):
        places = F.transform(_valid_places(text, kind, pattern), _span(kind, order))
        found.append(F.when(text.rlike(NEEDS[kind]), places))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    return F.sort_array(F.concat(*[F.coalesce(f, none) for f in found]))


def _valid_places(text: Column, kind: str, pattern: str) -> Column:
    return F.filter(_places(text, F.lit(pattern)), lambda x: valid(kind, x["m"]))


def _span(kind: str, order: int):
    value = (lambda m: F.lower(m)) if kind == "email" else (lambda m: m) if kind in ("ip", "secret") else _digits
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), value(x["m"]).alias("value")
    )


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def disclosing_terms(
    docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_terms: int = 100_000
) -> DataFrame:
    """``term, kind, share, action``: terms of ``docs(text)`` that disclose a protected entity.

    An entity is a value of a pattern, or the kind as a class; a context is a line. A term's
    disclosure is its pointwise mutual information with the entity over lines, as a share of the
    entity's information content: 1 if every line with the term has the entity, 0 if they are
    independent. Pairs must share ``support`` different lines, so that copies of one text are no
    evidence; counts run over all lines of all documents. A term that discloses several entities is
    listed with the most disclosed. Values in fewer lines can't reach the support with any term and
    are not paired; pair counts are added up before they are dealt, so a frequent term or entity is
    one row a task.
    """
    # No pattern matches across lines, so lines are searched by themselves, and whole texts but once, for the result.
    lines = docs.where(F.col("text").rlike("@|[0-9]")).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.where(F.col("line").rlike("@|[0-9]")).select("line", base_spans(F.col("line"), secrets=True).alias("s")).where(F.size("s") > 0)
    bare = F.col("line")
    for pattern in (KINDS["email"], KINDS["phone"], KINDS["card"], KINDS["ip"], SECRET):
        bare = F.regexp_replace(bare, pattern, " ")
    of = lambda value: F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), (x["value"] if value else F.lit("")).alias("value")))
    held = shared(lines.select(F.xxhash64("line").alias("line"), F.array_distinct(F.concat(of(True), of(False))).alias("e"), _terms(bare).alias("t")))
    each = held.select("line", F.explode("e").alias("e"), "t")
    seen = each.groupBy("e", "line").agg(F.count("*").alias("n")).groupBy("e").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_entity"))
    entities = shared(seen.where(F.col("n_lines") >= support).select("e", "n_entity"))
    n_entities = entities.count()
    if not n_entities:
        return entities.selectExpr("'' term", "'' kind", "cast(0 as double) share", "'' action").limit(0)
    listed = F.broadcast(entities) if n_entities <= broadcast_terms else entities
    pairs = each.join(listed.select("e"), "e", "left_semi").select("line", "e", F.explode("t").alias("term"))
    # Few rows: a pair that meets in fewer lines is dropped while the lines are added up.
    together = pairs.groupBy("e", "term", "line").agg(F.count("*").alias("n")).groupBy("e", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_lines"))
    together = shared(together.where(F.col("n_lines") >= support).select("e", "term", "n_both"))
    count = together.count()
    every = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    words = every.select(F.explode(_terms(F.col("line"))).alias("term"))
    known = together.select("term").distinct()
    words = words.join(F.broadcast(known) if count <= broadcast_terms else known, "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = every.count()
    both = together.join(entities, "e").join(counts, "term")
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    share = F.coalesce(F.try_divide(mutual, content), F.lit(0.0))
    both = both.select("term", "e.kind", share.alias("share")).where(F.col("share") >= generalise)
    best = both.groupBy("term").agg(F.max(F.struct("share", "kind")).alias("b")).select("term", "b.kind", "b.share")
    return shared(best.withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise")))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_terms: int = 100_000
) -> DataFrame:
    """``id, text, spans`` of each row; ``spans`` are (start, order, end, kind, value), of the base kinds, ``secret`` and ``term``.

    Offsets are code points, the end exclusive. A disclosing term is marked wherever it stands as a
    word, in all documents; its ``value`` says ``remove`` or ``generalise`` and the kind disclosed.
    Null texts are empty and have no spans; null ids and repeated rows stay; an empty table gives
    an empty result; other columns are ignored. Only built-in functions are used.
    """
    rows = pack(docs, id=F.col(id_col), text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn("spans", base_spans(F.col("text"), secrets=True))
    terms = disclosing_terms(rows, support, generalise, remove, broadcast_terms)
    count = terms.count()
    if not count:
        return rows
    # A row is known by two hashes of id and text, since ids may be null or repeated.
    key = {"r1": F.xxhash64("id", "text"), "r2": F.xxhash64("text", "id")}
    words = rows.where(F.length("text") > 0).withColumns(key).select("r1", "r2", F.explode(_terms(F.col("text"))).alias("term"))
    listed = F.broadcast(terms) if count <= broadcast_terms else terms
    told = F.concat("action", F.lit(":"), "kind")
    hits = words.join(listed, "term").groupBy("r1", "r2").agg(F.map_from_entries(F.collect_set(F.struct("term", told))).alias("terms"))
    # A row for each text with a term, and few have one: texts are dealt only beyond the bound.
    hits = shared(hits)
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    rows = rows.withColumns(key).join(hits, ["r1", "r2"], "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("terms"), "|"), F.lit(r")(?!\p{L})"))
    places = F.transform(
        _places(F.col("text"), pattern),
        lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER.index("term")).alias("order"), x["end"].alias("end"), F.lit("term").alias("kind"), F.element_at("terms", F.lower(x["m"])).alias("value")),
    )
    return rows.select("id", "text", F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", places))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with spans and generalised terms as [KIND], and removed terms left out; of overlapping spans the first counts."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        kind = F.when(x["kind"] == "term", F.substring_index(x["value"], ":", -1)).otherwise(x["kind"])
        mark = F.when((x["kind"] == "term") & x["value"].startswith("remove:"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
        cut = F.struct(at.alias("a"), x["start"].alias("b"), mark.alias("mark"))
        free = x["start"] >= at
        return F.when(free, x["end"]).otherwise(at), F.when(free, F.array(cut)).otherwise(F.array().cast("array<struct<a:int,b:int,mark:string>>"))

    def cut(points: Column) -> Column:
        piece = lambda a, b: F.decode(F.substring(points, 4 * a + 1, 4 * (b - a)), "UTF-32")
        cuts = _scan(spans, F.lit(0), "struct<a:int,b:int,mark:string>", step)
        parts = F.array_join(F.transform(cuts, lambda x: F.concat(piece(x["a"], x["b"]), x["mark"])), "")
        end = F.aggregate(spans, F.lit(0), lambda at, x: F.when(x["start"] >= at, x["end"]).otherwise(at))
        return F.concat(parts, piece(end, F.floor(F.octet_length(points) / 4).cast("int")))

    # Four bytes a character, so that a piece far into the text is reached at once.
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(F.encode(text, "UTF-32")), cut), F.lit(0))).otherwise(text)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
