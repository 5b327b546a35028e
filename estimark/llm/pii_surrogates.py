"""Personal data replaced by keyed, type-consistent surrogates.

Emails, IPv4 addresses, IBANs, card-like numbers, social security numbers,
phone numbers and titled person names are found in whole texts.  Every entity
(its type and normal form: digits without separators, lower-cased emails and
names) gets one surrogate from a keyed digest, so mentions of an entity in
different formats, and a person's family name with or without the given name,
stay the same entity everywhere.  A surrogate keeps the type and the format:
separators, letter case, lengths, the top-level domain, a country code, the
first digit and the check digit of a card number, the gender that the title
tells and the script of a name.

Collision checks: a surrogate must not be another entity's surrogate, nor any
original of its type in the corpus; entities that fail draw again with the
next attempt number until all hold (the smallest normal form keeps a drawn
surrogate).  A round works on the failed entities only.

Texts are only moved where something was found: the entities' mentions are
aggregated per distinct text, and texts without mentions pass straight
through.

Defined cases: a null text stays null and an empty one empty; equal texts get
equal results, so repeated rows and rows without doc_id need no care; an
empty table gives an empty result; all columns of the input are kept, with
``n_entities`` added (an input column of that name is replaced).  DataFrame
and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estimark.session import materialize

# What an entity looks like, in order of precedence, and titles with the gender they tell.
_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "u": ("Dr", "Prof"),
}
_NAME = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}[\p{Ll}\p{M}]+)?"
_TITLED = "(?:" + "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True)) + r")\.? "
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _END),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("iban", _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END),
    ("card", _EDGE + r"(?:[0-9]{4}[ -]){3}[0-9]{4}" + _END + "|" + _EDGE + r"[0-9]{13,19}" + _END),
    ("ssn", _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END),
    ("phone", r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}" + _END
     + r"|(?<![A-Za-z0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + _END
     + "|" + _EDGE + r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}" + _END),
    ("person", r"(?<![\p{L}\p{N}])" + _TITLED + rf"{_NAME}(?: {_NAME}){{0,2}}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
# Name parts by script; a name is syllables and an ending, longer with every attempt.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "je", "ki", "lo", "ma", "ne", "pi", "ro", "sa", "te", "vi", "wo"),
    "cyrillic": ("ба", "ве", "ги", "до", "за", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "фе", "хи", "шо"),
    "greek": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"),
}
ENDINGS = {
    "latin": {"given_m": "rick", "given_f": "lina", "given_u": "ren", "family": "mont"},
    "cyrillic": {"given_m": "слав", "given_f": "мила", "given_u": "ша", "family": "енко"},
    "greek": {"given_m": "νικος", "given_f": "νικη", "given_u": "νις", "family": "ιδου"},
}
ATTEMPTS = 200  # draws before a form counts as exhausted (an error, never a shared surrogate)


def _type(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        out = F.when(m.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def _entities(m: Column, kind: Column) -> Column:
    """(type, normal form) of every entity in a mention: names are taken apart, all else is one."""
    plain = F.struct(kind.alias("kind"), F.when(kind == "email", F.lower(m)).when(kind == "ip", m)
                     .when(kind == "phone", F.regexp_replace(m, "[^0-9+]", "")).otherwise(F.regexp_replace(m, "[ -]", "")).alias("norm"))
    title = F.regexp_extract(m, r"\A(\p{L}+)", 1)
    gender = F.when(title.isin(*TITLES["m"]), "given_m").when(title.isin(*TITLES["f"]), "given_f").otherwise("given_u")
    names = F.slice(F.split(m, " "), F.lit(2), F.size(F.split(m, " ")) - 1)
    taken = F.transform(names, lambda x, i: F.struct(
        F.when(i == F.size(names) - 1, F.lit("family")).otherwise(gender).alias("kind"), F.lower(x).alias("norm")))
    return F.when(kind == "person", taken).otherwise(F.array(plain))


def _stream(key: str, kind: Column, norm: Column, attempt: int) -> Column:
    """256 keyed hex digits per entity and attempt."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(f"{attempt}.{i}")), 256) for i in range(4)]
    return F.concat(*parts)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i * 2, F.lit(256)) + 1, F.lit(2)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo 10."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10


def _shaped(norm: Column, stream: Column, kept: Column) -> Column:
    """The normal form with letters and digits drawn anew, but for its first ``kept`` characters."""
    def draw(c, i):
        b = _byte(stream, i)
        return (F.when(i < kept, c).when(c.rlike("[0-9]"), (b % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char(b % 26 + 97)).when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).otherwise(c))
    return F.array_join(F.transform(F.split(norm, ""), draw), "")


def _picked(table: Column, stream: Column):
    return lambda i: F.element_at(table, _byte(stream, i) % 16 + 1)


def _surrogate(kind: Column, norm: Column, key: str, attempt: int) -> Column:
    s = _stream(key, kind, norm, attempt)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_shaped(F.concat(local, F.lit("@"), host), s, F.lit(0)), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(s, i) % 254 + 1).cast("string")), ".")
    drawn = _shaped(norm, s, F.lit(1))
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.when(_luhn(norm) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)
    phone = _shaped(norm, s, F.when(norm.startswith("+"), 2).otherwise(0))
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    name = F.lit(None).cast("string")
    for sc, parts in SYLLABLES.items():
        table = F.array(*map(F.lit, parts))
        said = F.transform(F.sequence(F.lit(0), F.lit(2 + attempt)), _picked(table, s))
        ending = F.lit(ENDINGS[sc]["family"])
        for g in ("given_m", "given_f", "given_u"):
            ending = F.when(kind == g, F.lit(ENDINGS[sc][g])).otherwise(ending)
        name = F.when(script == sc, F.concat(F.array_join(said, ""), ending)).otherwise(name)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "iban", _shaped(norm, s, F.lit(2))).when(kind == "ssn", _shaped(norm, s, F.lit(0))).otherwise(name))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) from distinct (kind, norm): drawn by the key, distinct, and no original of the kind."""
    left, attempt, done = materialize(entities), 0, None
    originals = left.select(F.col("kind").alias("k"), F.col("norm").alias("o"))
    while True:
        drawn = left.select("kind", "norm", _surrogate(F.col("kind"), F.col("norm"), key, attempt).alias("surrogate"))
        first = Window.partitionBy("kind", "surrogate").orderBy("norm")
        drawn = drawn.withColumn("ok", F.row_number().over(first) == 1)
        hit = originals.withColumn("hit", F.lit(True))
        drawn = drawn.join(hit, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("o")), "left").drop("k", "o")
        if done is not None:
            used = done.select(F.col("kind").alias("k"), F.col("surrogate").alias("o"), F.lit(True).alias("used"))
            drawn = drawn.join(used, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("o")), "left").drop("k", "o")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        drawn = materialize(drawn.withColumn("ok", F.col("ok") & F.col("hit").isNull() & F.col("used").isNull()))
        good = drawn.filter("ok").select("kind", "norm", "surrogate")
        done = good if done is None else done.unionByName(good)
        left = drawn.filter("NOT ok").select("kind", "norm")
        if not left.limit(1).count():
            return done
        attempt += 1
        if attempt > ATTEMPTS:
            raise RuntimeError(f"no free surrogate is left for the form of {left.first()}")


def _written(mention: Column, kind: Column, got: Column) -> Column:
    """A mention rewritten with its entities' surrogates: separators, case and title stay."""
    one = F.element_at(got, 1)
    # digits and letters of the surrogate flow into the mention's own separators
    places = F.split(mention, "")
    signs = F.when(kind == "phone", F.lit("[0-9+]")).otherwise(F.lit("[^ -]"))
    flow = F.array_join(F.transform(places, lambda c, i: F.when(
        F.regexp_like(c, signs), F.substring(one, F.length(F.array_join(F.filter(
            F.slice(places, F.lit(1), i + 1), lambda x: F.regexp_like(x, signs)), "")), F.lit(1))).otherwise(c)), "")
    email = F.when(mention == F.upper(mention), F.upper(one)).otherwise(one)
    title = F.concat(F.substring_index(mention, " ", 1), F.lit(" "))
    person = F.concat(title, F.array_join(F.transform(got, F.initcap), " "))
    return F.when(kind == "person", person).when(kind == "email", email).when(kind == "ip", one).otherwise(flow)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_entities``, the mentions replaced.  ``key`` is the secret."""
    body = F.col(text).cast("string")
    # every entity holds a digit, an @ or a title: plain searches spare most texts the patterns
    hint = body.rlike("[@0-9]")
    for title in sorted({t for ts in TITLES.values() for t in ts}):
        hint = hint | body.contains(title)
    found = F.when(hint, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    columns = [c for c in docs.columns if c not in (text, "n_entities")]
    rows = docs.select(*columns, body.alias("__text"), found.alias("__found"))
    clean = rows.filter("coalesce(size(__found), 0) <= 0").withColumn("n_entities", F.lit(0)).withColumnRenamed("__text", text)
    marked = rows.filter("size(__found) > 0").withColumn("__md5", F.md5("__text"))

    mentions = materialize(marked.select(F.col("__md5").alias("md5"), F.col("__found").alias("found")).dropDuplicates(["md5"]))
    told = mentions.select(F.explode("found").alias("mention")).distinct().withColumn("type", _type(F.col("mention")))
    told = materialize(told.withColumn("parts", _entities(F.col("mention"), F.col("type"))))
    parts = told.select("mention", "type", F.posexplode("parts").alias("at", "e")).select("mention", "type", "at", "e.kind", "e.norm")
    table = surrogates(parts.select("kind", "norm").distinct(), key)
    got = (parts.join(table, ["kind", "norm"]).groupBy("mention", "type")
           .agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("got")))
    new = got.select("mention", _written(F.col("mention"), F.col("type"), F.col("got.surrogate")).alias("new"))
    placed = (mentions.select("md5", F.posexplode("found").alias("at", "mention")).join(new, "mention")
              .groupBy("md5").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new")))
    texts = marked.join(placed.select(F.col("md5").alias("__md5"), F.col("new.new").alias("__new")), "__md5")
    pieces = F.split(F.col("__text"), ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.col("__new"), lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    texts = texts.withColumn(text, whole).withColumn("n_entities", F.size("__new"))
    order = [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    return clean.select(*order).unionByName(texts.select(*order))
