"""Personal data and information-theoretic sanitisation, in DataFrame functions only.

Fixed patterns find the protected entities. The corpus then tells how strongly the terms around an entity reveal it: the
pointwise mutual information of term and entity, as a share of the information content of the entity. A term that is
found with one entity and nowhere else has share 1. What a term tells of an entity's class (mail domain, network, issuer,
dialling code) and kind counts too, so that entities that occur once are covered. Terms over a threshold are generalised to their class (number, name,
word), those over a second one removed, wherever they stand beside that entity; texts without entities are left alone.

Work is linear in a text but for running sums over its matches, which cost the power 1.5 of their number in array copies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm.common import saved, text_docs

#: The base kinds in the order in which spans at one place are listed; terms come last.
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
#: As the contract's patterns, with possessive repeats (no backtracking, no recursion) and a guard that a match starts
#: where its first run starts or where the last match ended: within one run, later starts fail as the first one does. A
#: card's least number of digits is part of its pattern, as a run that has fewer of them has no start that has enough.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition without which a kind cannot occur.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MARK = "\ue000"
TERM = r"[\p{L}\p{N}]{3,}+"
MATCHES = "array<struct<start:int,stop:int,value:string>>"
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: Code points in the pieces that a text is cut into, so that a place in it is found without reading all that is before.
PIECE = 1000


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of ints, op over all before it, from 0; op is associative.

    Within runs of about the root of the array's length, and over the runs.
    """
    none = F.expr("cast(array() as array<int>)")

    def grown(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def scan(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), grown, lambda acc: acc["out"])

    def whole(xs: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), step), lambda i: F.slice(xs, i + 1, step))

        def joined(runs: Column) -> Column:
            ends = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), op))
            return F.flatten(F.zip_with(runs, scan(ends, F.lit(0)), scan))

        return bound(runs, joined)

    return bound(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of a pattern's matches, offsets in code points.

    Matches are put between marks and the text is split at the marks, so that every second part is a match. A mark in
    the text itself counts as a line feed, which no pattern here takes.
    """

    def found(parts: Column) -> Column:
        at = running(F.transform(parts, lambda p: F.char_length(p)), lambda a, b: a + b)
        marked = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("odd")))
        every = F.zip_with(marked, at, lambda m, a: F.struct(a.alias("start"), (a + F.char_length(m["p"])).alias("stop"), m["p"].alias("value"), m["odd"].alias("odd")))
        return F.transform(F.filter(every, lambda m: m["odd"]), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value")))

    parts = F.split(F.regexp_replace(F.translate(text, MARK, "\n"), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return bound(parts, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(F.expr(f"cast(array() as {MATCHES})")))


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass Luhn's check."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The condition that a match of the kind has to meet besides its pattern."""
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        part = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) < 4) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, "[.]"), part)
    if kind == "card":
        return F.when(digits.between(12, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind."""

    def of(i: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["value"]))
        found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["stop"].alias("stop"), m["value"].alias("value")))
        hint = HINTS[kind]
        return F.when(F.contains(text, F.lit(hint)), found).otherwise(F.expr(f"cast(array() as {SPAN})")) if hint else found

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS[:4]))))


def entity(kind: Column, value: Column) -> Column:
    """What a span protects: cards and phone numbers by their digits, others in lower case."""
    return F.concat_ws(":", kind.cast("string"), F.when(kind >= 2, F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def contexts(own: DataFrame, words: int) -> DataFrame:
    """(row, entity, place, term, written, start, stop): the nearest `words` terms on either side of every entity.

    own: (row, text, base). Terms are runs of three letters and digits or more that overlap no base span. Terms and spans
    of a text are put in one order, in which windows look back and ahead.
    """
    tokens = F.transform(matches(F.col("text"), TERM), lambda m: F.struct(m["start"].alias("start"), F.lit(4).alias("kind"), m["stop"].alias("stop"), m["value"].alias("value")))
    rows = own.select("row", F.explode(F.concat("base", tokens)).alias("t")).select("row", "t.*")
    base = F.col("kind") < 4
    ahead, back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")), Window.partitionBy("row").orderBy("start", "kind")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("next", F.min(F.when(base, F.col("start"))).over(so_far(ahead)))
    rows = rows.withColumn("last", F.max(F.when(base, F.col("stop"))).over(so_far(back)))
    clear = (F.coalesce("last", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("stop")) >= F.col("stop"))
    rows = rows.where(base | clear).withColumn("term", F.when(~base, F.struct("value", "start", "stop")))
    order = "ignore nulls over (partition by row order by start, kind)"
    near = [F.expr(f"{way}(term, {i}) {order}") for way in ("lag", "lead") for i in range(1, words + 1)]
    met = rows.withColumn("near", F.array(*near)).where(base)
    met = met.select("row", entity(F.col("kind"), F.col("value")).alias("entity"), F.col("start").alias("place"), F.explode(F.array_compact("near")).alias("m"))
    return met.select("row", "entity", "place", F.lower("m.value").alias("term"), F.col("m.value").alias("written"), "m.start", "m.stop")


def term_counts(docs: DataFrame, wanted: DataFrame, most_bytes: int = 64_000_000) -> DataFrame:
    """(term, n_term): occurrences over all texts of the wanted terms. Counts leave each task summed.

    Wanted terms are broadcast, so that no other leaves a task, where they take up most_bytes at most (16 bytes and the
    term each); more of them meet the counts after these are shuffled. The result is the same.
    """
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where(F.char_length("term") >= 3)
    wanted = saved(wanted.select("term").distinct())
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("n")).first()["n"]
    if size <= most_bytes:
        return found.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    return found.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term", "left_semi")


def shares(met: DataFrame, entities: DataFrame, terms: DataFrame, total: int, support: int) -> DataFrame:
    """(entity, term, n_both, n_entity, n_term, surroundings, share) of pairs with so many surroundings or more.

    share = PMI(term; entity) / IC(entity), with p(entity) its occurrences, p(term) the term's and p(both) the term's
    places beside the entity, each over `total` terms. entities: (entity, n_entity). surroundings: how many different sets of terms the pair was met
    in, so that copies of one text are no evidence.
    """
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.countDistinct("context").alias("surroundings"))
    all_three = pairs.where(F.col("surroundings") >= support).join(entities, "entity").join(terms, "term")
    ic = -F.log2(F.col("n_entity") / F.lit(float(total)))
    pmi = F.log2(F.least(F.col("n_both"), F.col("n_term")) * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    return all_three.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0))


def group(entity: Column) -> Column:
    """The class of an entity: mail domain, network (all but the last part), issuer (six digits), dialling code (three digits)."""
    kind, value = F.substring(entity, 1, 1), F.substring(entity, 3, 1 << 30)
    of = F.when(kind == "0", F.regexp_extract(value, "@(.*)$", 1)).when(kind == "1", F.regexp_replace(value, "[.][0-9]+$", "")).when(kind == "2", F.substring(value, 1, 6)).otherwise(F.substring(value, 1, 3))
    return F.concat(kind, F.lit("/"), of)


def backed_off(met: DataFrame, entities: DataFrame, terms: DataFrame, total: int, support: int, strength: float) -> DataFrame:
    """(entity, term, share) of every pair, also of entities that occur once: what a term tells of an entity's kind and class.

    The chance of an entity beside a term is estimated from kind to class (`group`) to entity. Where a pair was met in
    `support` different surroundings or more, a level's chance is (n_both + strength * prior) / (n_term + strength); with
    fewer it is its prior. The prior is the chance of the level above, times the level's part of that one; a kind's is
    its own share of all terms. share = log2(chance / p(entity)) / IC(entity).
    """
    three = F.array(F.col("entity"), group(F.col("entity")), F.substring("entity", 1, 1))
    pairs = met.select("term", "context", F.posexplode(three).alias("level", "key")).groupBy("level", "key", "term").agg(F.count("*").alias("n"), F.countDistinct("context").alias("surroundings"))
    pairs = saved(pairs)
    sizes = entities.select("n_entity", F.posexplode(three).alias("level", "key")).groupBy("level", "key").agg(F.sum("n_entity").alias("size"))
    known = pairs.join(sizes, ["level", "key"])

    def level(i: int, name: str) -> DataFrame:
        return known.where(F.col("level") == i).select(F.col("key").alias(name), "term", F.col("size").alias(f"size_{i}"), F.when(F.col("surroundings") >= support, F.col("n")).alias(f"n_{i}"))

    rows = level(0, "entity").withColumns({"class": group(F.col("entity")), "kind": F.substring("entity", 1, 1)})
    rows = rows.join(level(1, "class"), ["class", "term"]).join(level(2, "kind"), ["kind", "term"]).join(terms, "term")
    chance = F.col("size_2") / F.lit(float(total))
    for i in (2, 1, 0):
        prior = chance if i == 2 else chance * F.col(f"size_{i}") / F.col(f"size_{i + 1}")
        seen = (F.least(f"n_{i}", "n_term") + strength * prior) / (F.col("n_term") + strength)
        rows = rows.withColumn("chance", F.when(F.col(f"n_{i}").isNotNull(), seen).otherwise(prior))
        chance = F.col("chance")
    own = F.col("size_0") / F.lit(float(total))
    return rows.select("entity", "term", F.when(own < 1, F.log2(chance / own) / -F.log2(own)).otherwise(0.0).alias("share"))


def evidence(docs: DataFrame, words: int = 5, support: int = 2, strength: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(found, met, shares, backed off): every row's base spans (row, doc_id, hash, base), the terms beside entities, and
    what they reveal: of entities met with them in several surroundings, and by class of all.
    """
    rows = text_docs(docs)
    found = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    n_terms = (F.char_length(F.regexp_replace("text", r"[\p{L}\p{N}]+", "")) + 1).cast("long")
    found = saved(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("hash"), "base", F.when(F.size("base") > 0, F.col("text")).alias("text"), n_terms.alias("terms_about")))
    total = int(found.agg(F.coalesce(F.sum("terms_about"), F.lit(1))).first()[0])
    met = contexts(found.where("text IS NOT NULL").select("row", "text", "base"), words)
    beside = F.collect_list("term").over(Window.partitionBy("row", "entity", "place"))
    met = saved(met.withColumn("context", F.xxhash64(F.array_sort(beside))))
    entities = found.select(F.explode("base").alias("s")).groupBy(entity(F.col("s.kind"), F.col("s.value")).alias("entity")).agg(F.count("*").alias("n_entity"))
    entities, terms = saved(entities), saved(term_counts(rows, met))
    return found.select("row", "doc_id", "hash", "base"), met, shares(met, entities, terms, total, support), backed_off(met, entities, terms, total, support, strength)


def spans(docs: DataFrame, words: int = 5, generalise: float = 0.6, remove: float = 0.9, support: int = 2, strength: float = 1.0) -> DataFrame:
    """(row, doc_id, hash, base, terms): each row's base spans, and its revealing terms as (start, stop, removed, class).

    A term is revealing beside an entity if its share of the entity's information is `generalise` or more, in `support`
    different surroundings or more of the entity itself (`shares`) or of its class or kind (`backed_off`); from `remove`
    on it is removed. Null and empty texts have neither; equal rows have
    equal spans; a null doc_id stays null; an empty table gives no rows; columns other than doc_id and text are ignored.
    Offsets are code points, ends exclusive.
    """
    found, met, *told = evidence(docs, words, support, strength)
    bad = reduce(DataFrame.unionByName, (t.where(F.col("share") >= generalise).select("entity", "term", "share") for t in told))
    bad = saved(bad.groupBy("entity", "term").agg((F.max("share") >= remove).alias("removed")))
    kind = F.when(F.col("written").rlike(r"^\p{N}+$"), "number").when(F.col("written").rlike(r"^\p{Lu}"), "name").otherwise("word")
    hits = met.join(bad, ["entity", "term"]).groupBy("row", "start", "stop").agg(F.max("removed").alias("removed"), F.max(kind).alias("class"))
    terms = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "removed", "class"))).alias("terms"))
    none = F.expr("cast(array() as array<struct<start:int,stop:int,removed:boolean,class:string>>)")
    return found.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): protected entities give way to <EMAIL>, <IP>, <CARD> or <PHONE>, revealing terms to their class or to nothing.

    Of spans that overlap, all is replaced, by the mark of the one that starts first; the listed kind order decides at
    one start. Null texts come back as empty, texts without spans as they are, repeated rows each; a null doc_id stays
    null; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    rows = text_docs(docs).withColumn("hash", F.xxhash64("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = spans(docs, **options).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "hash", "base", "terms").dropDuplicates(["id", "hash"])
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), names[s["kind"]].alias("mark")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["stop"].alias("stop"), F.when(s["removed"], "").otherwise(F.concat(F.lit("<"), F.upper(s["class"]), F.lit(">"))).alias("mark")))
    cuts = found.select("id", "hash", F.array_sort(F.concat(base, terms)).alias("cuts")).where(F.size("cuts") > 0)
    return rows.join(cuts, ["id", "hash"], "left").select("doc_id", F.when(F.size("cuts") > 0, cut_out(F.col("text"), F.col("cuts"))).otherwise(F.col("text")).alias("text"))


def cut_out(text: Column, cuts: Column) -> Column:
    """A text with the marks of sorted cuts in place of what they cover."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(p: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        tail = F.coalesce(F.get(p, j), F.lit(""))
        one = F.substring(tail, a % PIECE + 1, b - a)
        more = F.concat(F.substring(F.get(p, i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(p, i + 2, j - i - 1), ""), F.substring(tail, F.lit(1), b % PIECE))
        return F.when(i == j, one).otherwise(more)

    def done(p: Column) -> Column:
        before = running(F.transform(cuts, lambda c: c["stop"]), lambda a, b: F.greatest(a, b))
        each = F.zip_with(cuts, before, lambda c, at: F.when(c["start"] >= at, F.concat(part(p, at, c["start"]), c["mark"])).otherwise(""))
        return F.concat(F.array_join(each, ""), part(p, F.array_max(F.transform(cuts, lambda c: c["stop"])), F.char_length(text)))

    return bound(pieces, done)


def listed(base: Column, terms: Column | None = None) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    every = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    if terms is not None:
        every = F.array_sort(F.concat(every, F.transform(terms, lambda s: F.struct(s["start"].alias("start"), F.when(s["removed"], 5).otherwise(4).alias("kind"), s["stop"].alias("stop")))))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_private, n_generalised, n_removed, base_sha256, spans) of every row; see `spans`.

    n_private: all base spans; spans lists these and then, as generalised or removed, the terms.
    """

    def counted(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    n = [counted(i) for i in range(4)]
    acts = [F.size(F.filter("terms", lambda s: s["removed"] == removed)).cast("long").alias(f"n_{kind}") for removed, kind in ((False, "generalised"), (True, "removed"))]
    found = spans(docs, **options)
    return found.select("doc_id", *n, F.size("base").cast("long").alias("n_private"), *acts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("base"), F.col("terms")).alias("spans"))
