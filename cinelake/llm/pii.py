"""Surrogates for personal data, in DataFrame operations.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, phone
numbers, card numbers, social security numbers, IBANs, long hexadecimal keys,
and person names (after a form of address, or a known given name before a
capitalised word). Each is brought to a normal form, so that the same entity
written in another case or with other separators is one entity.

Every entity gets a surrogate from a keyed hash of its kind and normal form:
letters become letters of the same script, digits digits, separators stay; an
e-mail keeps its top-level domain and addresses of one domain stay together;
octets stay octets; a phone number keeps its country code; a card number keeps
its first digit and, if its check digit is right, gets a right one; a known
given name becomes another name of the same gender and script, other names get
invented ones with an ending of that gender. The surrogate is then written in
the form of each mention: its case and separators.

Surrogates are checked over the whole table: where two entities of a kind have
the same surrogate, or a surrogate is a real entity, all but one get the next
attempt, round by round, until all are distinct. Letter kinds grow by a
character after every eighth attempt, so a small space of short names ends.

Only the distinct entities are shuffled by entity; mentions are joined to the
distinct written forms, and texts without an entity are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import cut_lineage, fresh, stored
from cinelake.operators.indexing import group_row_number
from cinelake.session import broadcast_if_small

KEY = "surrogate-key-1"
#: Rows of a table that may be broadcast.
SMALL = 300_000

# Common given names by gender and script, and forms of address.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Andrew Paul Peter George Hans Klaus Jürgen Stefan Wolfgang Jean Pierre Michel Philippe Jacques Carlos José Luis Miguel Antonio".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Anna Laura Julia Ursula Monika Sabine Petra Heike Marie Nathalie Isabelle Sylvie Catherine Carmen Ana Isabel Dolores Pilar".split(),
    ("m", "cyrillic"): "Иван Дмитрий Сергей Алексей Андрей Михаил Николай Владимир Павел Юрий".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
}
ADDRESS = {"m": "Mr Herr Señor Sr Monsieur Sir Lord".split(), "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Lady".split(), "n": "Dr Prof".split()}

# Country codes of one and two digits; the others have three.
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_FORMS = "|".join(n for names in ADDRESS.values() for n in names)
_W = r"\p{L}\p{N}"
_HEX = "[0-9a-fA-F]"
# a capitalised word, also with an apostrophe or a hyphen inside
_CAP = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)?"
_KINDS = "|".join(
    [
        rf"(?<![._%+-])[{_W}._%+-]++@[{_W}-]++(?:\.[{_W}-]++)+",
        rf"{_HEX}{{32,}}+(?![{_W}])",
        rf"(?=[a-fA-F:]*\d)(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?:{_HEX}{{1,4}}:){{1,6}}(?::{_HEX}{{1,4}}){{1,6}})(?![{_W}:])",
        rf"(?<!\.)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){{3}}(?!\.?[{_W}])",
        rf"(?<!\+)\+\d{{1,3}}(?:[^{_W}+@\n]{{1,7}}\d{{2,5}}){{2,4}}(?![{_W}])",
        rf"(?<!\+)\+(?:\d{{8,15}}|\d{{1,3}}[ -]\d{{6,12}})(?![{_W}])",
        rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_W}])",
        rf"(?<!-)(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}}|\d{{3}}-\d{{2}}-\d{{4}}|(?:1-)?(?:\(?\d{{3}}\)?[ .-]|\(\d{{3}}\))\d{{3}}[.-]\d{{4}})(?![{_W}])",
        rf"(?=\p{{Lu}})(?:(?iu:{_FORMS})\.? {_CAP}(?: \p{{Lu}}\.)?(?: {_CAP})?|(?iu:{_NAMES})(?: \p{{Lu}}\.)? {_CAP}(?: {_CAP})?)(?![{_W}])",
    ]
)
# an entity begins where a word does, so the kinds are tried there only
_PATTERN = rf"(?<![{_W}])(?:{_KINDS})"
_ALNUM = r"[^\p{L}\p{N}]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind(raw: Column) -> Column:
    """Kind of a written form."""
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike(r"^[0-9a-fA-F]{32,}$") & ~raw.rlike(r"^\d{32,}$"), "token")
        .when(raw.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(raw.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$"), "ip6")
        .when(raw.rlike(r"^\+"), "phone")
        .when(raw.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(raw.rlike(r"^(?:1-)?\(?\d{3}\)?[ .-]?\d{3}[.-]\d{4}$"), "phone")
        .when(raw.rlike(r"^\d"), "card")
        .otherwise("person")
    )


def _lower_set(names: list[str]) -> Column:
    return F.array(*[F.lit(n.lower()) for n in names])


def _parts(raw: Column, kind: Column) -> Column:
    """(kind, normal form, written form) of the entities of a written form: the words of a person's name, else itself.

    A form of address and an initial are kept: their parts have no kind.
    """
    # without a separator the country code ends where the numbering plan says
    first_digits = F.when(raw.rlike(r"^\+\d{8,}$"), F.regexp_extract(raw, rf"^\+({_COUNTRY})", 1)).otherwise(F.regexp_extract(raw, r"^\+(\d{1,3})", 1))
    digits = F.regexp_replace(raw, r"\D", "")
    plain = F.when((kind == "phone") & raw.startswith("+"), F.concat(F.lit("+"), first_digits, F.lit(" "), F.substring(digits, F.length(first_digits) + 1, F.length(digits)))).otherwise(
        F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", F.upper(F.regexp_replace(raw, r"\s", ""))).otherwise(F.lower(raw))
    )
    words = F.split(raw, " ")
    titled = F.lower(F.regexp_replace(F.element_at(words, 1), r"\.$", ""))
    forms = {g: [w.lower() for w in names] for g, names in ADDRESS.items()}
    gender = F.when(titled.isin(*forms["m"]), "m").when(titled.isin(*forms["f"]), "f").when(titled.isin(*forms["n"]), "n")

    def word(w: Column, i: Column) -> Column:
        known = F.lit(None).cast("string")
        for (g, script), names in GIVEN.items():
            known = F.when(F.array_contains(_lower_set(names), F.lower(w)), f"given-{g}-{script}").otherwise(known)
        title = gender.isNotNull() & (i == 0)
        # after a form of address the last word is the family name
        last = i == F.size(words) - 1
        # an unknown word inside a name is a family name like the last one, so both have one surrogate
        unknown = F.when(gender.isNull(), "family").otherwise(F.concat(F.lit("name-"), gender))
        what = F.when(title | w.rlike(r"^\p{Lu}\.$"), F.lit(None).cast("string")).when(last, "family").otherwise(F.coalesce(known, unknown))
        return F.struct(what.alias("kind"), F.lower(w).alias("norm"), w.alias("word"))

    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("norm"), raw.alias("word"))))


def _stream(seed: Column, n: Column) -> Column:
    """At least ``2 * n`` hexadecimal digits of a keyed hash."""
    blocks = F.sequence(F.lit(0), F.floor(n / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")), 256)), "")


def _same_kind(text: Column, seed: Column) -> Column:
    """Every letter or digit of a string replaced by one of the same script and kind."""

    def with_stream(hexes: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            v = F.conv(F.substring(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
            pick = lambda alphabet: F.substring(F.lit(alphabet), v % len(alphabet) + 1, F.lit(1))
            return (
                F.when(c.rlike(r"^\d$"), (v % 10).cast("string"))
                .when(c.rlike(r"^[Ѐ-ӿ]$"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
                .when(c.rlike(r"^[Ͱ-Ͽ]$"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
                .when(c.rlike(r"^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike(r"^\p{L}$"), pick("abcdefghijklmnopqrstuvwxyz"))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    return _let(_stream(seed, F.length(text)), with_stream)


def _hexadecimal(text: Column, seed: Column) -> Column:
    return F.substring(_stream(seed, F.length(text)), F.lit(1), F.length(text))


def _hexadecimal_groups(text: Column, seed: Column) -> Column:
    """Every character but the colons replaced by a hexadecimal digit."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return _let(_stream(seed, F.length(text)), lambda hexes: F.array_join(F.transform(letters, lambda c, i: F.when(c == ":", c).otherwise(F.substring(hexes, i + 1, F.lit(1)))), ""))


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _card(norm: Column, seed: Column) -> Column:
    body = F.concat(F.substring(norm, 1, 1), _same_kind(F.substring(norm, F.lit(2), F.length(norm) - 1), seed))

    def checked(digits: Column) -> Column:
        zero = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
        return F.when(_luhn_sum(norm) % 10 == 0, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((10 - _luhn_sum(zero) % 10) % 10).cast("string"))).otherwise(digits)

    return _let(body, checked)


def _invented(norm: Column, kind: Column, seed: Column) -> Column:
    """A pronounceable lower-case name in the script of ``norm``; female given names end in a, male ones in a consonant."""

    def with_stream(hexes: Column) -> Column:
        value = lambda i: F.conv(F.substring(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int")

        def name(consonants: str, vowels: str, a: str, n: str) -> Column:
            syllable = lambda i: F.concat(F.substring(F.lit(consonants), value(2 * i) % len(consonants) + 1, F.lit(1)), F.substring(F.lit(vowels), value(2 * i + 1) % len(vowels) + 1, F.lit(1)))
            count = F.greatest(F.lit(3), F.ceil(F.length(norm) / 2).cast("int"))
            stem = F.array_join(F.transform(F.sequence(F.lit(1), count), syllable), "")
            return F.when(kind.endswith("-f") | kind.contains("-f-"), F.concat(stem, F.lit(n + a))).when(kind.endswith("-m") | kind.contains("-m-"), F.concat(stem, F.lit(n))).otherwise(stem)

        return F.when(norm.rlike(r"[Ѐ-ӿ]"), name("бвгдзклмнпрст", "аеиоу", "а", "н")).otherwise(name("bdfgklmnprstvz", "aeiou", "a", "n"))

    return _let(_stream(seed, F.lit(4) + 2 * F.length(norm)), with_stream)


def _rotated(norm: Column, names: list[str], key: str) -> Column:
    """The next name in a keyed order of the list: distinct for distinct names, and never the same."""
    listed = F.array_sort(F.array(*[F.struct(F.sha2(F.lit(f"{key}|{n.lower()}"), 256).alias("h"), F.lit(n.lower()).alias("name")) for n in names]))
    order = F.transform(listed, lambda s: s["name"])
    return _let(order, lambda o: F.element_at(o, (F.array_position(o, norm) % len(names) + 1).cast("int")))


def _surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a normal form."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    grown = F.concat(norm, F.repeat(F.lit("x"), F.floor(attempt / 8).cast("int")))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    longer = F.concat(local, F.repeat(F.lit("x"), F.floor(attempt / 8).cast("int")))
    email = F.concat(_same_kind(longer, seed), F.lit("@"), _same_kind(inner, F.concat_ws("|", F.lit(key), F.lit("domain"), inner)), F.lit("."), top)
    octets = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (F.conv(F.substring(F.sha2(seed, 256), 4 * i + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string"))
    country = F.substring_index(norm, " ", 1)
    phone = F.when(norm.startswith("+"), F.concat(country, F.lit(" "), _same_kind(F.substring_index(norm, " ", -1), seed))).otherwise(_same_kind(norm, seed))
    out = F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "ip6", _hexadecimal_groups(norm, seed)).when(kind == "phone", phone).when(kind == "card", _card(norm, seed))
    out = out.when(kind == "token", _hexadecimal(grown, seed)).when(kind == "iban", F.concat(F.substring(norm, 1, 2), _same_kind(F.substring(norm, F.lit(3), F.length(norm)), seed))).when(kind == "ssn", _same_kind(norm, seed))
    for (g, script), names in GIVEN.items():
        out = out.when(kind == f"given-{g}-{script}", _rotated(norm, names, key))
    return out.otherwise(_invented(grown, kind, seed))


def _written(word: Column, kind: Column, norm: Column, surrogate: Column) -> Column:
    """A surrogate in the form of a mention: its separators, and its case letter by letter (a name's by the whole word)."""
    upper = (F.upper(word) == word) & (F.lower(word) != word)
    name = F.when(upper & (F.length(word) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    core = F.regexp_replace(surrogate, _ALNUM, "")
    letters = F.filter(F.split(word, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(word, F.lit(1), i + 1), _ALNUM, ""))
        s = F.substring(core, k, F.lit(1))
        return F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(s)).otherwise(s)).otherwise(c)

    same = F.array_join(F.transform(letters, one), "")
    same_shape = F.length(F.regexp_replace(word, _ALNUM, "")) == F.length(core)
    # a key has the case of the whole: letters may stand where the real one has digits
    shaped = F.when(kind.isin("ip", "ip6", "token"), F.when(upper, F.upper(surrogate)).otherwise(surrogate)).when(same_shape, same).otherwise(F.when(upper, F.upper(surrogate)).otherwise(surrogate))
    return F.when(kind.isNull(), word).when(kind.rlike("^(given|name|family)"), name).otherwise(shaped)


#: Entities of one form trade places when there are more than one in so many of its possible values.
CROWDED = 4


def _space(kind: Column, norm: Column) -> Column:
    """(name, size) of the values that a surrogate of a fixed form can have; null for kinds whose surrogates grow."""
    shape = F.regexp_replace(F.regexp_replace(norm, "[A-Z]", "A"), r"\d", "9")
    digits = F.length(F.regexp_replace(norm, r"\D", ""))
    ten = lambda n: F.pow(F.lit(10.0), n)
    country = F.when(norm.startswith("+"), F.substring_index(norm, " ", 1)).otherwise("")
    local = F.length(F.substring_index(norm, " ", -1))
    valid = _luhn_sum(norm) % 10 == 0
    named = lambda size, *facts: F.struct(F.concat_ws("|", kind, *facts).alias("space"), size.cast("double").alias("size"))
    return (
        F.when(kind == "phone", named(ten(local), country, local.cast("string")))
        .when(kind == "ssn", named(ten(digits)))
        .when(kind == "ip", named(F.lit(254.0**4)))
        .when(kind == "ip6", named(F.pow(F.lit(16.0), F.length(F.regexp_replace(norm, ":", ""))), F.regexp_replace(norm, "[0-9a-f]", "0")))
        .when(kind == "card", named(ten(digits - F.when(valid, 2).otherwise(1)), F.substring(norm, 1, 1), digits.cast("string"), valid.cast("string")))
        .when(kind == "iban", named(ten(digits) * F.pow(F.lit(26.0), F.length(norm) - digits - 2), F.substring(norm, 1, 2), shape))
    )


def _traded(real: DataFrame, key: str) -> DataFrame:
    """``kind, norm, surrogate`` of the entities whose form has few free values: each takes the next one's place in a keyed order."""
    placed = real.select("kind", "norm", _space(F.col("kind"), F.col("norm")).alias("s")).filter("s is not null").select("kind", "norm", "s.*")
    crowd = cut_lineage(placed.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).filter(F.col("n") * CROWDED > F.col("size")).select("space", "n"))
    if not crowd.take(1):
        return real.filter("false").withColumn("surrogate", F.col("norm"))
    inside = placed.select("kind", "norm", "space").join(broadcast_if_small(crowd, SMALL), "space").withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), F.lit("trade"), "norm"), 256))
    ranked = cut_lineage(group_row_number(inside, ["space"], ["h", "norm"]))
    after = ranked.select("space", F.col("rn").alias("at"), F.col("norm").alias("surrogate"))
    return cut_lineage(ranked.withColumn("at", F.col("rn") % F.col("n") + 1).join(after, ["space", "at"]).select("kind", "norm", "surrogate"))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, norm, surrogate`` of distinct ``entities (kind, norm)``: distinct within a kind, and none a real entity of it.

    Entities that fill more than a quarter of the values of their form (all
    phone numbers of four digits, say) trade places by a keyed order, as the names of
    a known list do: distinct, and never their own, but real ones of others. So
    a round settles at least half of what is open, and the rounds end.
    """
    real = cut_lineage(entities.select("kind", "norm"))
    traded = _traded(real, key)
    free = real.join(traded.select("kind", "norm"), ["kind", "norm"], "left_anti")
    settled = cut_lineage(free.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.lit(0), key)))
    taken = real.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("is_real"))
    while True:
        keeper = settled.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        # names of a known list only trade places among themselves
        clash = keeper.join(taken, ["kind", "surrogate"], "left").filter("n > 1 or (is_real and kind not like 'given-%')").select("kind", "surrogate", F.when(F.col("is_real"), F.lit(None)).otherwise(F.col("keeper.norm")).alias("stays"))
        clash = cut_lineage(clash)
        if not clash.take(1):
            return settled.select("kind", "norm", "surrogate").unionByName(traded)
        again = settled.join(clash, ["kind", "surrogate"], "left_semi").join(clash, ["kind", "surrogate"]).filter("not (norm <=> stays)").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        again = cut_lineage(again.withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)))
        settled = cut_lineage(settled.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(again))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of ``docs (doc_id, text, ...)`` with ``text`` holding surrogates, and ``entities``.

    ``entities`` lists the mentions in order as (kind, surrogate): the kind and
    the text that stands there now; empty if there are none. Null and empty
    texts stay as they are, very long ones are read whole. A later mention of a person by
    one word only is not found. Repeated rows give repeated results; a column named
    ``entities`` is replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    pattern = F.lit(_PATTERN)
    docs = docs.drop("entities")
    k1, k2, mine = fresh(docs, "_k1"), fresh(docs, "_k2"), fresh(docs, "_found")
    row = [F.xxhash64("doc_id", "text").alias(k1), F.xxhash64(F.lit("second"), F.col("text"), F.col("doc_id")).alias(k2)]
    some = F.regexp_extract_all(text, pattern, F.lit(0))
    found = stored(docs.select(*row, some.alias("raws")).filter(F.size("raws") > 0).distinct(), spark, "pii-mentions")
    mentions = found.select(k1, k2, F.posexplode("raws").alias("pos", "raw"))
    forms = cut_lineage(mentions.select("raw").distinct())
    typed = forms.withColumn("kind", _kind(F.col("raw")))
    parts = cut_lineage(typed.select("raw", F.col("kind").alias("of"), F.posexplode(_parts(F.col("raw"), F.col("kind"))).alias("n", "part")).select("raw", "of", "n", "part.*"))
    given = surrogates(parts.filter("kind is not null").select("kind", "norm").distinct(), key)
    named = parts.join(given, ["kind", "norm"], "left").withColumn("new", _written(F.col("word"), F.col("kind"), F.col("norm"), F.col("surrogate")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("n", "new"))), lambda s: s["new"])
    written = cut_lineage(named.groupBy("raw", "of").agg(F.array_join(pieces, " ").alias("new")))
    per_row = mentions.join(broadcast_if_small(written, SMALL), "raw").groupBy(k1, k2).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("of").alias("kind"), F.col("new").alias("surrogate")))).alias(mine))
    per_row = cut_lineage(per_row)
    entities = F.transform(mine, lambda s: F.struct(s["kind"].alias("kind"), s["surrogate"].alias("surrogate")))
    has = F.coalesce(text.rlike(_PATTERN), F.lit(False))
    clean = docs.filter(~has).withColumn("entities", F.expr("cast(array() as array<struct<kind:string,surrogate:string>>)"))
    with_some = docs.filter(has).select("*", *row).join(per_row, [k1, k2])
    between = F.split(text, _PATTERN, -1)
    whole = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(mine, i)["surrogate"], F.lit("")))), "")
    changed = with_some.withColumn("text", whole).withColumn("entities", entities)
    return clean.unionByName(changed.select(*clean.columns))
