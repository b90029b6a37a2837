"""Personal data: fixed shapes, and terms that give a protected entity away. DataFrame functions only.

Information-theoretic sanitisation (after Sanchez & Batet, 2016): the spans of fixed shape are the
protected entities. Over the whole corpus, the pointwise mutual information of a term and an
entity says how much the term reveals of it; divided by the information of the entity, it is 1
when the term occurs with that entity only. Terms are all words of a document, wherever in it.
Those whose share exceeds a threshold, with co-occurrence in at least ``support`` documents, are
reported for generalisation at every place of the documents that hold the entity.

Scale. One pass takes the spans out of each text; documents without an entity end there. Texts
are identified by digest, so copies are worked out once and count as often as they occur. Pairs
are made only for entities of ``support`` documents or more. Pairs and the document frequencies
of words, which count every document, are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.plans.cut import stored

# The shapes that must be found. Runs are possessive where no shorter run could
# match, which keeps very long texts linear; \G allows a local part right after a match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# End of fixed values.
#: Terms are unbroken runs of letters.
WORD = r"\p{L}++"
KINDS = ("email", "ip", "card", "phone", "term")
_QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
SPAN = "struct<start:int,k:int,kind:string,stop:int>"

#: Share of an entity's information that a term may reveal, and documents that must say so.
MAX_DISCLOSURE, SUPPORT = 0.8, 2


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _turns(text: str, pattern: str) -> str:
    """Each match ``m`` with the length ``g`` of the piece before it; what follows the last has no match."""
    pieces = f"transform(split({text}, {pattern}, -1), p -> length(p))"
    return f"zip_with(regexp_extract_all({text}, {pattern}, 0), {pieces}, (m, g) -> named_struct('m', m, 'g', g))"


TURN = "struct<k:int,i:int,g:int,n:int,entity:string>"


def _found(kind: str, pattern: str, text: str) -> str:
    """All matches of a kind by turns: its number, the piece before it and its length in code points, and its entity if it passes."""
    k = KINDS.index(kind)
    quick = f"contains({text}, '@')" if kind == "email" else f"{text} rlike {_quoted(_QUICK[kind])}"
    turn = f"named_struct('k', {k}, 'i', i, 'g', x.g, 'n', length(x.m), 'entity', if({_passes(kind, 'x.m')}, concat('{kind}:', lower(x.m)), null))"
    return f"if({quick}, transform(filter({_turns(text, _quoted(pattern))}, x -> x.m is not null), (x, i) -> {turn}), cast(array() as array<{TURN}>))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _passes(kind: str, m: str) -> str:
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as bigint), 0) <= 255)"
    if kind == "phone":
        return f"length({_digits(m)}) between 10 and 15"
    if kind == "card":  # Luhn: from the right, every second digit doubled
        digit = "cast(substring(reverse(" + _digits(m) + "), i + 1, 1) as int)"
        return (
            f"aggregate(sequence(0, length({_digits(m)}) - 1), 0, (s, i) -> s + "
            f"if(i % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))) % 10 = 0"
        )
    return "true"


def base_turns(text: str = "text") -> Column:
    """All matches of the fixed shapes in ``text`` (not null), passing or not, by turns."""
    found = [_found(k, p, text) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))]
    return F.expr(f"concat({', '.join(found)})")


def _spans(turns: DataFrame, row: str = "row") -> DataFrame:
    """``(row, base, entities)`` from ``(row, turns)``: the passing matches as spans, by start and then kind.

    Places are running sums over the turns of a row and kind, so the work is in proportion to them.
    """
    spread = turns.select(row, F.inline("turns"))
    before = Window.partitionBy(row, "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("stop", F.sum(F.col("g") + F.col("n")).over(before).cast("int")).filter("entity IS NOT NULL")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    span = F.struct((F.col("stop") - F.col("n")).alias("start"), "k", kind.alias("kind"), "stop")
    return placed.groupBy(row).agg(F.array_sort(F.collect_list(span)).cast(f"array<{SPAN}>").alias("base"), F.collect_set("entity").alias("entities"))


def _words(text: str = "text") -> Column:
    """The distinct words of a text, in lower case."""
    return F.expr(f"array_distinct(transform(regexp_extract_all({text}, {_quoted(WORD)}, 0), w -> lower(w)))")


def _first_pass(docs: DataFrame) -> DataFrame:
    """Spans and entities; ``key`` is the text's digest, null without a span, and so is the text. ``row`` tells rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("turns", base_turns())
    marked = F.expr("exists(turns, x -> x.entity is not null)")
    rows = turns.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.when(marked, F.sha2("text", 256)).alias("key"),
        F.when(marked, F.col("text")).alias("text"),
        F.when(marked, F.col("turns")).alias("turns"),
    )
    rows = stored(rows, "turns")
    spans = _spans(rows.filter("key IS NOT NULL").select("row", "turns"))
    plain = rows.filter("key IS NULL").select("doc_id", "row", "key", "text", F.expr(f"cast(array() as array<{SPAN}>)").alias("base"), F.lit(None).cast("array<string>").alias("entities"))
    return plain.unionAll(rows.filter("key IS NOT NULL").drop("turns").join(spans, "row").select(plain.columns))


def _repeated(found: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Entities of ``support`` documents or more ``(entity, n_e)``, and the texts that hold them ``(key, entity, row, n)``.

    ``row`` is the first row with the text, ``n`` the number of them.
    """
    keys = found.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "entities")).alias("x"))
    held = stored(keys.select("key", "n", "x.row", F.explode("x.entities").alias("entity")), "held")
    n_e = stored(held.groupBy("entity").agg(F.sum("n").alias("n_e")).filter(F.col("n_e") >= support), "entities")
    return n_e, stored(held.join(n_e.select("entity"), "entity"), "repeated")


def disclosing(
    docs: DataFrame, found: DataFrame, n_e: DataFrame, held: DataFrame, max_disclosure: float = MAX_DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """``(entity, term, share)`` of the terms that reveal more of an entity than they may.

    ``found`` is the stored result of the first pass over ``docs``, ``n_e`` and ``held`` are those of ``_repeated``.
    """
    texts = held.groupBy("row").agg(F.first("n").alias("n"), F.collect_list("entity").alias("entities"))
    words = found.filter("key IS NOT NULL").select("row", "text").join(texts, "row").select("n", "entities", F.explode(_words()).alias("term"))
    pair = words.select("n", "term", F.explode("entities").alias("entity"))
    joint = stored(pair.groupBy("entity", "term").agg(F.sum("n").alias("n_te")).filter(F.col("n_te") >= support), "joint")
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_t = text.select(F.explode(_words()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t") >= support)
    n_docs = found.count()
    shares = joint.join(n_t, "term").join(n_e, "entity")
    information = F.log2(n_docs / F.col("n_e"))
    share = F.log2(F.col("n_te") * n_docs / (F.col("n_t") * F.col("n_e"))) / information
    return shares.filter(information > 0).select("entity", "term", share.alias("share")).filter(F.col("share") > max_disclosure)


def _places(texts: DataFrame) -> DataFrame:
    """``(key, term, start, stop)`` of every word of ``texts``, a row for each key."""
    # a piece before each word and one after the last, which has no word
    turns = texts.select("key", F.posexplode(F.expr(_turns("text", _quoted(WORD)))).alias("i", "x"))
    before = Window.partitionBy("key").orderBy("i")
    stop = F.sum(F.col("x.g") + F.coalesce(F.length("x.m"), F.lit(0))).over(before).cast("int")
    return turns.select("key", F.lower("x.m").alias("term"), (stop - F.length("x.m")).alias("start"), stop.alias("stop")).filter("term IS NOT NULL")


def scan(docs: DataFrame, max_disclosure: float = MAX_DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``(doc_id, spans)``, one row for each row of ``docs``.

    ``spans`` is an array of (start, k, kind, stop) in code points, stop exclusive, by start and
    then kind as in ``KINDS``: the fixed shapes, and all places of the disclosing terms of the
    document's entities that overlap none of them. Null texts are empty and have none. Repeated
    rows and null doc_ids keep their rows and count as documents; other columns do not matter.
    """
    found = stored(_first_pass(docs), "found")
    n_e, held = _repeated(found, support)
    flagged = stored(held.join(disclosing(docs, found, n_e, held, max_disclosure, support), "entity").select("row", "key", "term").distinct(), "flagged")
    texts = found.filter("key IS NOT NULL").select("row", "key", "text").join(flagged.select("row").distinct(), "row", "left_semi")
    terms = _places(texts).join(flagged, ["key", "term"]).select("key", "start", "stop")
    terms = _free(terms, found.filter("key IS NOT NULL").select("key", F.col("base")).join(flagged.select("row", "key").distinct().select("key").distinct(), "key", "left_semi"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    plain = found.filter("key IS NULL").select("doc_id", F.col("base").alias("spans"))
    marked = found.filter("key IS NOT NULL").select("doc_id", "key", "base").join(terms, "key", "left")
    return plain.union(marked.select("doc_id", F.array_sort(F.concat("base", F.coalesce("terms", none))).alias("spans")))


def _free(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """``(key, terms)``: the places that overlap no base span, as spans. ``texts``: ``(key, base)``, copies of a key alike.

    By place: a base span counts from its start, a term is asked at its stop, and overlaps if a
    base span that began before then stops after the term's start.
    """
    base = texts.groupBy("key").agg(F.first("base").alias("base")).select("key", F.inline("base"))
    at = base.select("key", F.col("start").alias("at"), F.lit(1).alias("what"), "start", "stop").unionAll(
        terms.distinct().select("key", F.col("stop").alias("at"), F.lit(0).alias("what"), "start", "stop")
    )
    so_far = Window.partitionBy("key").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("what") == 1, F.col("stop"))).over(so_far)
    free = at.withColumn("reach", reach).filter((F.col("what") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("k"), F.lit("term").alias("kind"), "stop")
    return free.groupBy("key").agg(F.collect_list(span).cast(f"array<{SPAN}>").alias("terms"))


def generalised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets."""
    return F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
                s["stop"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
