"""Personal data by patterns, and terms that disclose it by corpus co-occurrence. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers found by pattern and
checked (parts, Luhn, digit counts). Each distinct value is a protected entity. A term (a run of 4 or more letters
that overlaps no base span) discloses an entity when more than SHARE of the documents that hold the term hold the entity, and their pointwise
mutual information over the corpus's documents, less its standard error at the number of documents that hold both, reaches
DISCLOSE of the entity's information content. So a rare word is no disclosure by itself, and one shared document is weaker evidence than many.
Documents are counted whole, and entities of a single document are judged like others. A disclosing
term is marked wherever it occurs, in documents without the entity too: removed from REMOVE of the information content on,
below it generalised; with several entities the stronger mark holds. Entities of exactly the same documents tell nothing apart, so one stands
for all, and a page of thousands of addresses is counted once.

The patterns are those of the contract, rewritten so that Java's matcher never backtracks over long
runs or recurses: possessive runs that start where a run starts (or the last match ended), and cards
as whole maximal digit sequences of 13 to 19 digits.

Edge cases: null and empty texts have no spans; rows with equal id and text are one document in the
counts and each keep their row; rows that share an id but not a text are different documents; null
ids work as any id; extra columns are ignored; an empty table gives an empty result. Spans are code
points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import put_back, row_key, set_aside, written

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DISCLOSE, REMOVE, SHARE = 0.75, 0.95, 0.5
#: Runs that terms are.
_RUN = r"(?<!\p{L})\p{L}{4,}+"
#: Matches whose offsets are summed up at once.
_CHUNK = 128
_BUCKETS = 1 << 20
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _let(value, then):
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def found(text, pattern: str, kind: str):
    """Every match of pattern as struct(kind, start, end, value). Offsets are sums of the lengths of gaps and matches: within chunks, and over the chunks' totals, so that
    no list grows by one at a time but for a chunk's length."""
    kind, zero = F.lit(kind).alias("kind"), F.lit(0).cast("bigint")
    pairs = lambda v: F.zip_with(F.slice(F.split(text, F.lit(pattern), -1), F.lit(1), F.size(v)), v, lambda g, x: F.struct(F.char_length(g).cast("bigint").alias("gap"), x.alias("value")))

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        end = begin + F.char_length(pair["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(kind, begin.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("out"))

    def chunked(p):
        firsts = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int")), lambda c: F.slice(p, c * _CHUNK + 1, F.lit(_CHUNK)))
        return F.transform(firsts, lambda own: F.aggregate(own, F.struct(zero.alias("at"), F.array().cast(_SPAN).alias("out")), step))

    def shifted(chunks):
        ahead = F.aggregate(chunks, F.array(zero), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + c["at"]))
        moved = lambda c, by: F.transform(c["out"], lambda s: F.struct(kind, (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(chunks, F.slice(ahead, F.lit(1), F.size(chunks)), moved))

    none = F.array().cast(_SPAN)
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.when(F.size(v) > 0, _let(pairs(v), lambda p: _let(chunked(p), shifted))).otherwise(none))


def luhn(digits):
    """True where the Luhn sum of a string of digits is a multiple of 10."""
    value = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")  # noqa: E731  i from 1, from the right
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)) % 10 == 0


def base_spans(text):
    """All base spans of a non-null text, by kind as listed, then start."""
    none = F.array().cast(_SPAN)
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    email = F.when(F.contains(text, F.lit("@")), found(text, EMAIL, "email")).otherwise(none)
    ip = F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(found(text, IP, "ip"), lambda s: F.rlike(s["value"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")))).otherwise(none)
    card = F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), F.filter(found(text, CARD, "card"), lambda s: luhn(digits(s["value"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(found(text, PHONE, "phone"), lambda s: F.char_length(digits(s["value"])).between(9, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def _replaced(text, spans, word):
    """text with word(span) for each of spans, which are ordered by start; what overlaps one already replaced stays so."""

    def step(acc, s):
        from_ = F.greatest(acc["at"], s["start"])
        one = F.struct(acc["at"].alias("after"), from_.alias("from"), s.alias("span"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], one).alias("out"))

    def joined(cuts):
        say = lambda c: F.concat(F.substr(text, (c["after"] + 1).cast("int"), (c["from"] - c["after"]).cast("int")), F.when(c["span"]["end"] > c["after"], word(c["span"])).otherwise(""))
        return F.concat(F.array_join(F.transform(cuts["out"], say), ""), F.substr(text, (cuts["at"] + 1).cast("int"), F.char_length(text)))

    none = "array<struct<after:bigint,from:bigint,span:struct<start:bigint,end:bigint,kind:string>>>"
    return _let(F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(none).alias("out")), step), joined)


def _apart(runs, base):
    """Those of runs that overlap no base span."""
    return F.when(F.size(base) > 0, F.filter(runs, lambda t: ~F.exists(base, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))).otherwise(runs)


def _terms(text, base):
    """Distinct terms of a text."""
    plain = F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: F.char_length(w) >= 4)
    beside = F.transform(_apart(found(text, _RUN, "term"), base), lambda t: F.lower(t["value"]))
    # lower-casing may turn a letter into two characters of which one is no letter; such texts go by their runs
    same = F.char_length(F.lower(text)) == F.char_length(text)
    return F.array_distinct(F.when((F.size(base) == 0) & same, plain).otherwise(beside))


def _bucket(column: str):
    """At most _BUCKETS values, for a broadcast that spares a shuffle nearly all rows that it cannot need."""
    return F.pmod(F.xxhash64(column), F.lit(_BUCKETS)).alias("bucket")


def _disclosing(docs: DataFrame, n: int) -> DataFrame:
    """term, kind: the terms that disclose an entity, of n distinct documents (doc, entities, terms)."""
    having = docs.where(F.size("entities") > 0)
    held = having.select("doc", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.sum(F.col("doc").cast("decimal(38,0)")).alias("_sum"), F.bit_xor("doc").alias("_xor"))
    one = entities.groupBy("n_entity", "_sum", "_xor").agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    both = held.join(one, "entity").join(having.select("doc", "terms"), "doc").select("entity", "n_entity", F.explode("terms").alias("term"))
    both = written(both.groupBy("entity", "term").agg(F.first("n_entity").alias("n_entity"), F.count(F.lit(1)).alias("n_both")), "pii-both")
    words = docs.select(F.explode("terms").alias("term")).withColumn("bucket", _bucket("term"))
    words = words.join(F.broadcast(both.select(_bucket("term")).distinct()), "bucket", "left_semi")
    # a term in more documents than that has too small a share with any entity
    most = F.broadcast(both.agg(F.max("n_entity").alias("most")))  # one row
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).crossJoin(most).where(F.col("n_term") * SHARE < F.col("most")).drop("most")
    known = both.join(counted, "term").where(F.col("n_both") > SHARE * F.col("n_term"))
    content = F.log2(F.lit(n) / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * F.lit(n) / (F.col("n_term") * F.col("n_entity"))) - F.log2(F.exp(F.lit(1.0))) / F.sqrt("n_both")
    kind = F.when(shared >= REMOVE * content, "removed").otherwise("generalised")
    return known.where((content > 0) & (shared >= DISCLOSE * content)).groupBy("term").agg(F.max(kind).alias("kind"))


def analyse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _key, base (spans) and added (struct kind, start, end: terms to generalise or remove) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), text.alias("_text"))
    facts = source.withColumn("base", base_spans(F.col("_text")))
    facts = written(facts.select("_id", "_key", F.xxhash64("_id", "_key").alias("doc"), "base", _terms(F.col("_text"), F.col("base")).alias("terms")), "pii")
    n, most = facts.groupBy("doc").count().agg(F.count(F.lit(1)), F.max("count")).first()
    twice = (most or 0) > 1
    once = facts.dropDuplicates(["doc"]) if twice else facts
    entities = F.array_distinct(F.transform("base", lambda b: F.concat_ws(":", b["kind"], F.lower(b["value"]))))
    disclosing = written(_disclosing(once.select("doc", entities.alias("entities"), "terms"), n), "pii-terms")
    words = once.select("doc", F.explode("terms").alias("term")).withColumn("bucket", _bucket("term"))
    words = words.join(F.broadcast(disclosing.select(_bucket("term")).distinct()), "bucket", "left_semi").join(disclosing, "term")
    marks = written(words.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("marks")), "pii-marks")

    # only texts with marks are shuffled
    asked = source.select(F.xxhash64("_id", "_key").alias("doc"), "_text").withColumn("bucket", _bucket("doc")).join(F.broadcast(marks.select(_bucket("doc")).distinct()), "bucket", "left_semi")
    asked = asked.groupBy("doc").agg(F.first("_text").alias("_text")) if twice else asked
    texts = asked.join(marks, "doc").join(once.select("doc", "base"), "doc")
    runs = F.filter(found(F.col("_text"), _RUN, "term"), lambda t: F.map_contains_key("marks", F.lower(t["value"])))
    span = lambda t: F.struct(F.element_at("marks", F.lower(t["value"])).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))
    added = texts.select("doc", F.array_sort(F.transform(_apart(runs, F.col("base")), span)).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return facts.drop("terms").join(added, "doc", "left").select(F.col("_id").alias(id_col), "_key", "base", F.coalesce("added", none).alias("added"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined) for every row."""
    say = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base, added = F.transform("base", say), F.transform("added", say)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return analyse(df, id_col, text_col).select(id_col, *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with text_col rewritten: base values become [KIND], generalised terms [TERM], removed terms vanish."""
    df, own = set_aside(df, ("base", "added"))
    id_col, text_col = own[id_col], own[text_col]
    key = row_key(F.col(id_col), F.col(text_col))
    facts = analyse(df, id_col, text_col).where((F.size("base") > 0) | (F.size("added") > 0)).select(F.col(id_col).alias("_id2"), F.col("_key").alias("_key2"), "base", "added").dropDuplicates(["_id2", "_key2"])
    rows = df.withColumn("_key", key).join(facts, F.col("_key").eqNullSafe(F.col("_key2")) & F.col(id_col).eqNullSafe(F.col("_id2")), "left")
    spans = F.array_sort(F.transform(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: s))
    word = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    text = F.col(text_col)
    whole = _replaced(text, spans, word)
    return put_back(rows.withColumn(text_col, F.when(F.col("base").isNotNull(), whole).otherwise(text)), own)
