"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, require

#: Titles that tell a gender; fixed values.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña")
NEUTRAL = ("Dr", "Prof")
_WORDS = r"\p{Lu}[\p{L}'’-]*\p{L}"
TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
#: Type, pattern: in this order where several match at one place.
TYPES = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{3}[\x20.-]?\d{4}(?!\d)|\+\d{1,3}(?:[\x20.-]?\d){7,12}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    ("card", r"(?<![\p{L}\d.-])\d(?:[\x20-]?\d){12,18}(?![\d\p{L}])"),
    ("name", rf"(?<![\p{{L}}])(?:{TITLES})\.?\x20+{_WORDS}(?:\x20{_WORDS})?"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES)
#: A text without any of these has no entity.
HINT = rf"[@0-9]|(?:{TITLES})"
ATTEMPTS = 16
#: Most bytes of the retries that are broadcast; beyond that they are joined.
SMALL = 16 << 20


def entity_type(m: Column) -> Column:
    """The type of a match, by what its text alone tells."""
    digits = F.regexp_count(m, F.lit("[0-9]"))
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.lit("ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^\p{L}"), F.lit("name"))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.lit("phone"))
        .when(digits >= 13, F.lit("card"))
        .otherwise(F.lit("phone"))
    )


def normal(m: Column) -> Column:
    """What two mentions of one entity share: digits only, or the lowered text; names without their title."""
    kind = entity_type(m)
    name = F.lower(F.regexp_replace(m, rf"^(?:{TITLES})\.?\x20+", ""))
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, "[^0-9]", "")).when(kind == "name", name).otherwise(F.lower(m))


def _hex(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value), 256)


def _digits(h: Column) -> Column:
    """64 decimal digits of a hex digest."""
    return F.translate(h, "abcdef", "283746")


#: Letters of the digests in other scripts; fixed values.
LATIN, CYRILLIC, GREEK = "bdfgklmnprstvzhjaeiou", "бдфгклмнпрствзхжаеиоу", "βδφγκλμνπρστχζθξαειου"


def _in_script(like: Column, letters: Column, other: Column) -> Column:
    """Latin letters in the script of a text; other for Latin and for scripts without a list."""
    cyrillic = F.when(like.rlike(r"\p{IsCyrillic}"), F.translate(letters, LATIN, CYRILLIC))
    return cyrillic.when(like.rlike(r"\p{IsGreek}"), F.translate(letters, LATIN, GREEK)).otherwise(other)


def _cased(like: Column, made: Column) -> Column:
    """made in capitals if like is, with a capital if like has one, else small."""
    capital = F.substring(like, 1, 1).rlike(r"\p{Lu}")
    return F.when(capital & ~like.rlike(r"\p{Ll}") & ((F.length(like) > 1) | (F.length(made) == 1)), F.upper(made)).when(capital, F.initcap(made)).otherwise(made)


def _let(value: Column, use) -> Column:
    """use(value), with the value as a variable: its expression stands in the plan once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _like(m: Column, h: Column) -> Column:
    """m with every digit, and every letter in its case and script, replaced by those of a digest; the rest stays."""
    d = _digits(h)
    lower = F.translate(h, "0123456789abcdef", "bdgklmnprstvaeio")
    at = lambda s, i: F.substring(F.concat(s, s, s, s), i % 200 + 1, 1)
    turn = lambda c, i: (
        F.when(c.rlike("[0-9]"), at(d, i))
        .when(c.rlike("[a-z]"), at(lower, i))
        .when(c.rlike("[A-Z]"), F.upper(at(lower, i)))
        .when(c.rlike(r"\p{L}"), _let(at(lower, i), lambda v: _cased(c, _in_script(c, v, F.translate(v, "aeio", "áéíó")))))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), turn), "")


def _luhn(m: Column) -> Column:
    """m with its last digit such that the card check holds."""
    ds = F.filter(F.split(m, ""), lambda c: c.rlike("[0-9]"))
    n = F.size(ds)
    body = F.transform(F.slice(ds, F.lit(1), n - 1), lambda c, i: F.when((n - i) % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(F.transform(body, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.regexp_replace(m, "[0-9]$", ((F.lit(10) - total % 10) % 10).cast("string"))


def _word(key: str, w: Column, female: Column, male: Column, attempt: Column) -> Column:
    """A made-up name for a name's word: in its case and script, with an ending of its gender; hyphens and apostrophes stay."""

    def part(x: Column) -> Column:
        h = _hex(key, F.lit("word"), F.lower(x), attempt)
        syllables = F.concat(*[F.concat(F.substring(F.translate(h, "0123456789abcdef", "bdfgklmnprstvzhj"), 2 * i + 1, 1), F.substring(F.translate(h, "0123456789abcdef", "aeiouaeiouaeioue"), 2 * i + 2, 1)) for i in range(5)])
        made = F.concat(syllables, F.when(female, F.lit("a")).when(male, F.lit("n")).otherwise(F.lit("s")))
        return F.when(x.rlike(r"^\p{L}"), _let(_let(made, lambda v: _in_script(x, v, v)), lambda v: _cased(x, v))).otherwise(x)

    return F.array_join(F.transform(F.split(w, r"(?<=['’-])|(?=['’-])"), part), "")


def surrogate(m: Column, key: str, attempt: Column | None = None) -> Column:
    """The replacement of a match: a function of the key, the entity and the attempt, so mentions of one entity agree."""
    attempt = F.lit(0) if attempt is None else attempt
    kind, value = entity_type(m), normal(m)
    h = _hex(key, kind, value, attempt)
    octet = lambda i: F.conv(F.substring(h, i, 2), 16, 10)
    # 240/4 is reserved and never routed.
    ip = F.concat_ws(".", (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") + 240).cast("string"), octet(3), octet(5), octet(7))
    email = F.concat(_like(F.substring_index(m, "@", 1), h), F.lit("."), F.substring(h, 40, 8), F.lit("@"), F.substring(_hex(key, F.lit("domain"), F.lower(F.substring_index(m, "@", -1)), F.lit(0)), 1, 8), F.lit(".example"))
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[\x20.-]?\(|[\x20.-])", 0)
    # The digits alone seed the phone's, so another way of writing the same number keeps them.
    phone = F.concat(country, _like_digits(F.substring(m, F.length(country) + 1, F.length(m)), _digits(h)))
    title = F.regexp_extract(m, rf"^(?:{TITLES})\.?\x20+", 0)
    bare = F.regexp_extract(title, r"^[\p{L}]+", 0)
    words = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
    name = F.concat(title, F.array_join(F.transform(words, lambda w: _word(key, w, bare.isin(*FEMALE), bare.isin(*MALE), attempt)), " "))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _luhn(_like_digits(m, _digits(h)))).when(kind.isin("phone", "ssn"), F.when(kind == "phone", phone).otherwise(_like_digits(m, _digits(h)))).otherwise(name)


def _like_digits(m: Column, d: Column) -> Column:
    """m with its digits replaced in their order, the first by none of 0."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    empty = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.substring(d, acc["k"] + 1, 1)
        new = F.when((acc["k"] == 0) & (new == "0"), F.lit("9")).otherwise(new)
        return F.struct((acc["k"] + F.when(digit, 1).otherwise(0)).alias("k"), F.concat(acc["s"], F.when(digit, new).otherwise(c)).alias("s"))

    return F.aggregate(chars, empty, step, lambda a: a["s"])


def _collisions(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is another's, or is itself an entity of the corpus.

    Of entities that share a surrogate the smallest keeps it. Retries are checked in the same way, against all.
    """
    now = found.repartition(partitions(found.sparkSession), "kind", "value").withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        now = materialize(now.withColumn("made", normal(surrogate(F.col("sample"), key, F.col("attempt")))).select("kind", "value", "sample", "attempt", "made"), "entities")
        real = found.select("kind", F.col("value").alias("made"))
        taken = now.withColumn("r", F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "value")))
        bad = taken.join(real.withColumn("real", F.lit(True)), ["kind", "made"], "left").withColumn("again", (F.col("r") > 1) | F.coalesce("real", F.lit(False)))
        bad = materialize(bad.select("kind", "value", "sample", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again"), "attempts")
        now = bad.drop("again")
        if not bad.where("again").limit(1).count():
            return now.where("attempt > 0").select("kind", "value", "attempt")
    raise RuntimeError("surrogates still collide")


def replace_entities(docs: DataFrame, *, key: str, text_col: str = "text", out: str = "clean_text") -> DataFrame:
    """docs with out, the text with surrogates, and entities, array<struct<kind,hash>> in the order of the text.

    Distinct entities get distinct surrogates, none of which is an entity of the corpus: collisions are looked for over
    all distinct entities, and the few that collide are replaced anew. Mentions of one entity agree in all documents.
    Names are found behind a title of the lists and made of their words, so a later mention by title and surname has the
    same stem; the ending follows the title's gender. A name without a title stays.

    Only the entities are shuffled. The retries of the few texts with a collided entity come back by a hash of the text,
    which is the same for repeated rows: by a broadcast for at most SMALL bytes, else by a join. A null text stays null and has no entities.
    Texts and entities of any length are read whole. Other columns stay, but for one named entities or like out, which gives
    way. An empty table gives no rows. Only JVM functions run.
    """
    require(docs, text_col)
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    has = F.coalesce(text.rlike(HINT), F.lit(False))
    matches = F.when(has, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    # The hash names the text in the join; it is computed from the whole text.
    mentions = docs.select(F.xxhash64(text).alias("th"), F.explode(matches).alias("m")).select("th", "m", entity_type(F.col("m")).alias("kind"), normal(F.col("m")).alias("value"))
    mentions = materialize(mentions.distinct(), "mentions")
    found = mentions.groupBy("kind", "value").agg(F.min("m").alias("sample"))
    retries = materialize(_collisions(materialize(found, "found"), key), "retries")
    again = retries.limit(1).count() > 0
    rows = docs.withColumn("_m", matches)
    if again:
        redone = mentions.join(retries, ["kind", "value"]).groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("m", "attempt"))).alias("_retry"), F.sum(F.octet_length("m") + 32).alias("_bytes"))
        redone = materialize(redone.withColumnRenamed("th", "_th"), "redone")
        small = (redone.agg(F.sum("_bytes")).first()[0] or 0) <= SMALL
        redone = redone.drop("_bytes")
        rows = rows.withColumn("_th", F.xxhash64(text)).join(F.broadcast(redone) if small else redone, "_th", "left").drop("_th")
        attempt = lambda m: F.coalesce(F.try_element_at(F.col("_retry"), m), F.lit(0))
    else:
        attempt = lambda m: F.lit(0)
    made = F.transform("_m", lambda m: surrogate(m, key, attempt(m)))
    parts = F.split(text, PATTERN, -1)
    whole = F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size("_m")), made, lambda p, s: F.concat(p, s)), ""), F.element_at(parts, -1))
    entities = F.transform("_m", lambda m: F.struct(entity_type(m).alias("kind"), F.sha2(F.concat(F.lit(key), normal(m)), 256).alias("hash")))
    rows = rows.withColumn(out, F.when(F.size("_m") > 0, whole).otherwise(text)).withColumn("entities", entities)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (out, "entities")], out, "entities")


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = replace_entities(docs, key="priorwake")
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select("doc_id", F.col("clean_text").alias("text"), *[count(k) for k, _ in TYPES])
