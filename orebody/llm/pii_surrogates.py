"""PII: detection and keyed surrogates, with DataFrame functions only.

Entities are found by one pattern and typed by their own form. An entity's canonical form (digits of a phone or card number, the
address in lower case, a name without its title) and a secret key determine its surrogate, so that every mention, in any
spelling and document, receives the same replacement, written in the mention's own format: digits in the places of digits,
capitals for capitals, a title's gender, the script of the name, a valid or invalid check number (cards, IBANs) as before.

A name is found after one of the titles listed below; in a text where it is found, so is every further mention without a title, of the
whole name or the family name, as written there or in capitals. Family and first names are entities of their own, so that "Mr. John Smith", "John Smith", "Dr. Smith"
and "Smith" keep one family name. A neutral title takes its gender from other mentions of that name in the text.

Surrogates are checked over the whole table: if two entities of a type would share one, or one equals a real entity of the table,
all but one of them draw again, until all differ (first names: within a family name); after MOST_DRAWS draws an error says that a space
is too small. Only entities that drew again are joined to the texts; all others are computed in place.

The key is the caller's, or spark.orebody.pii.key, or else drawn at random for this process; surrogates agree between runs
only under the same key.

Edge cases: a null text stays null and has no entities; an empty text stays empty; repeated rows get the same surrogates; null ids are kept;
an empty table gives no rows; other columns pass through untouched, whatever their names, but for those that this adds.
Numbers of 13 to 19 digits, in one piece or in the groups that cards have, count as card numbers only if their check digit is right.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import UPPER, ascii_lower, discard, materialize, salted_join

MOST_DRAWS = 64
_own_key = secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The configured key, or this process's own."""
    return spark.conf.get("spark.orebody.pii.key", None) or _own_key


_TITLES_M = ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος"]
_TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "госпожа", "Госпожа", "κυρία", "Κυρία"]
_TITLES_N = ["Dr", "Prof", "Professor", "доктор", "Доктор"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted(_TITLES_M + _TITLES_F + _TITLES_N, key=lambda x: (-len(x), x)))
_TITLE_START = "[" + "".join(sorted({t[0] for t in _TITLES_M + _TITLES_F + _TITLES_N})) + "]"
_WORD = r"(?:\p{Lu}\p{L}{1,30}|\p{Lu}(?=['’]))(?:['’\-]\p{L}{2,30}){0,3}"
#: What stands before a value that is secret by its label; it belongs to the mention but not to the entity.
_LABEL = r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?"
#: Alternatives of the one pattern, tried in this order at each place. Each opens with its cheapest test, as most places are no start.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}+@(?:[\p{L}\p{N}][\p{L}\p{N}\-]{0,62}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?=[Ags])(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,})(?![\p{L}\p{N}])"
    rf"|(?=[pPsStTaA])(?<![\p{{L}}\p{{N}}]){_LABEL}[A-Za-z0-9_\-+/]{{8,}}(?![\p{{L}}\p{{N}}])"
    r"|(?=[0-9a-f])(?<![\p{L}\p{N}])(?=\d*+[a-f])(?=[a-f]*+\d)[0-9a-f]{32,}(?![\p{L}\p{N}])",
    "ip": rf"(?=\d)(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "phone": r"(?=[+(\d])(?:(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\p{N}\-]))",
    "ssn": r"(?=\d)(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{N}\-])",
    "card": r"(?=\d)(?<![\p{L}\p{N}.\-])(?:\d{13,19}|(?:\d{4}[ \-]){3}\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?![\p{L}\p{N}])",
    "name": rf"(?={_TITLE_START})(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?: {_WORD})?(?!\p{{L}})",
}
PATTERN = "|".join(PATTERNS.values())
#: A text in which none of these is found has no entity. Apart and each opening with a class of characters, as all texts are searched.
HINTS = ["[0-9@]", rf"{_TITLE_START}(?:{'|'.join(sorted({t[1:] for t in _TITLES_M + _TITLES_F + _TITLES_N}))})\.? ", r"[=:]\s{0,2}[\"']?[A-Za-z0-9_\-+/]{8}|[Ags](?:KIA[0-9A-Z]{16}|h[pousr]_[A-Za-z0-9]{36}|k-[A-Za-z0-9_\-]{20})"]

#: First names by script and gender, and syllables of family names by script.
_FIRST = {
    ("latin", "m"): "Alan Bruno Carl David Emil Felix George Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Emma Flora Greta Helen Irene Julia Karen Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χρυσή".split(),
}
_SYLLABLES = {
    "latin": "bal bren cor dal den fal gar hol jan kel lan mar nor pel ral sam tor vel wil zan".split(),
    "cyrillic": "бар вол гор дан жар кал лан мор нов пер рож сам тар фед".split(),
    "greek": "βαλ γαρ δαμ ζαν καλ λαμ μαρ νικ παλ ραν σαμ ταρ φιλ χαν".split(),
}
_ENDINGS = {"latin": {"m": "er", "f": "er"}, "cyrillic": {"m": "ов", "f": "ова"}, "greek": {"m": "ης", "f": "η"}}
_ALPHABETS = {r"[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", r"[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string, modulo 10."""
    n = F.length(digits)
    one = lambda i: F.coalesce(F.substr(digits, n - i + 1, F.lit(1)).try_cast("int"), F.lit(0))  # noqa: E731  Spark may evaluate this for other types too
    doubled = lambda i: F.when(one(i) * 2 > 9, one(i) * 2 - 9).otherwise(one(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(i)).otherwise(one(i))) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN without spaces, its first four characters put last, as a number modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(turned))), F.lit(0), step)


def entity_kind(m: Column) -> Column:
    """The type of a found string; null if it is no entity after all (a long number with a wrong check digit)."""
    whole = lambda k: m.rlike(rf"^(?:{PATTERNS[k]})$")
    digits = _digits(m)
    return (
        F.when(m.contains("@"), "email").when(whole("name"), "name").when(whole("ip"), "ip").when(whole("iban"), "iban")
        .when(m.rlike(r"^[+(]") | m.rlike(r"^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone").when(whole("ssn"), "ssn")
        .when(m.rlike(r"^[0-9 \-]+$") & F.length(digits).between(13, 19), F.when(_luhn(digits) == 0, "card"))
        .when(~whole("secret") & m.rlike(rf"^{_WORD}(?: {_WORD})?$"), "name")
        .otherwise("secret")
    )


def _name_parts(m: Column) -> tuple[Column, Column, Column, Column]:
    """Title (with what parts it from the name), bare name, gender (null: the title, or its lack, doesn't say), script."""
    title = F.regexp_extract(m, rf"^(?:{_TITLE})\.? ", 0)
    bare = F.substr(m, F.length(title) + 1)
    called = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(called.isin(_TITLES_F), "f").when(called.isin(_TITLES_M), "m")
    script = F.when(bare.rlike(r"\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return title, bare, gender, script


def canonical(m: Column, kind: Column, gender: Column) -> Column:
    """The form under which mentions of one entity meet; of a name, its family name's."""
    _, bare, _, script = _name_parts(m)
    family = F.concat_ws("|", script, F.when(script != "latin", gender), F.lower(F.substring_index(bare, " ", -1)))
    return F.when(kind.isin("phone", "ssn", "card"), _digits(m)).when(kind == "secret", F.regexp_replace(m, f"^{_LABEL}", "")).when(kind == "email", ascii_lower(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "name", family).otherwise(m)


def first_name(m: Column, kind: Column, gender: Column) -> Column:
    """The canonical form of a name's first name, which belongs to its family name; null if there is none."""
    _, bare, _, script = _name_parts(m)
    return F.when((kind == "name") & bare.contains(" "), F.concat_ws("|", gender, script, F.lower(F.substring_index(bare, " ", -1)), F.lower(F.substring_index(bare, " ", 1))))


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th (from 1) number from 0 to 255 of a hex digest, going round."""
    at = (i - 1) % 64 * 2 + 1 if isinstance(i, Column) else F.lit((i - 1) % 64 * 2 + 1)
    return F.conv(F.substr(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(digest: Column, i: int, words: list[str]) -> Column:
    big = _byte(digest, i) * 256 + _byte(digest, i + 1)
    return F.element_at(F.array(*map(F.lit, words)), big % len(words) + 1)


def _mapped(text: Column, digest: Column) -> Column:
    """Each digit, letter and capital replaced by one of its own sort; in words of hex digits, by hex digits."""
    hexed = text.rlike(r"^[0-9a-f]{8,}$") & text.rlike("[a-f]")

    def one(i: Column) -> Column:
        c, b = F.substr(text, i, F.lit(1)), _byte(digest, i)
        out = F.when(hexed, F.substr(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1))).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[A-Z]"), F.char(b % 26 + 65))
        for letters, alphabet in _ALPHABETS.items():
            out = out.when(c.rlike(letters), F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1)))
        return out.when(c.rlike(r"\p{L}"), F.char(b % 26 + 97)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), one), "")).otherwise("")


def draw_digest(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hex digits from the key, the type, the entity and the number of the draw."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)


def plain_surrogate(kind: Column, canon: Column, digest: Column, key: str) -> Column:
    """The entity letter by letter; an address's domain is drawn apart, so that neighbours in a domain stay neighbours."""
    domain = F.regexp_extract(canon, r"@(.*)\.[^.@]*$", 1)
    email = F.concat(_mapped(F.regexp_extract(canon, "^[^@]*", 0), digest), F.lit("@"), _mapped(domain, F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512)), F.lit(".example"))
    return F.when(kind == "email", email).when(kind.isin("ip", "family", "given"), F.lit("")).otherwise(_mapped(canon, digest))


def surrogate(kind: Column, canon: Column, d: Column, plain: Column) -> Column:
    """The canonical form of an entity's replacement (of a family name or first name, the name alone)."""
    ip = F.concat_ws(".", *[(1 + (_byte(d, 2 * i + 1) * 256 + _byte(d, 2 * i + 2)) % 254).cast("string") for i in range(4)])
    head = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(plain, F.lit(2)))  # the first digit stays: a country's or an issuer's
    body = F.substr(head, F.lit(1), F.length(head) - 1)
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    country, account = F.substr(canon, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    check = 98 - _mod97(F.concat(country, F.lit("00"), account))
    iban = F.when(kind == "iban", F.concat(country, F.lpad(F.when(_mod97(canon) == 1, check).otherwise((check - 1) % 97 + 2).cast("string"), 2, "0"), account))
    secret = F.when(canon.rlike("^(?:AKIA|gh[pousr]_)"), F.concat(F.substr(canon, F.lit(1), F.lit(4)), F.substr(plain, F.lit(5)))).when(canon.startswith("sk-"), F.concat(F.lit("sk-"), F.substr(plain, F.lit(4)))).otherwise(plain)
    family = F.lit("")
    for script in _SYLLABLES:
        for gender in ("m", "f"):
            syllables = [F.when(_byte(d, 30) % 4 >= i - 3, _pick(d, 3 + 2 * i, _SYLLABLES[script])).otherwise("") for i in range(6)]  # three to six
            whose = f"{script}|" if script == "latin" else f"{script}|{gender}|"
            family = F.when(canon.startswith(whose), F.initcap(F.concat(*syllables, F.lit(_ENDINGS[script][gender])))).otherwise(family)
    given = F.lit("")
    for (script, gender), first in _FIRST.items():
        given = F.when(canon.startswith(f"{gender}|{script}|"), F.concat(_pick(d, 1, first), F.when(plain == "double", F.concat(F.lit("-"), _pick(d, 3, first))).otherwise(""))).otherwise(given)
    return (
        F.when(kind == "email", plain).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("phone", "ssn"), F.when(F.length(canon) > 10, head).otherwise(plain))
        .when(kind == "iban", iban).when(kind == "family", family).when(kind == "given", given).otherwise(secret)
    )


def _with(e: Column, have: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[e[n].alias(n) for n in have], *[c.alias(n) for n, c in more.items()])


def _plain(kind: Column, canon: Column, digest: Column, attempt: Column, key: str) -> Column:
    return F.when(kind == "given", F.when(attempt > 0, "double").otherwise("")).otherwise(plain_surrogate(kind, canon, digest, key))


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    """`surrogate` from kind, canon and attempt, in steps, so that no step repeats another's work."""
    rows = rows.withColumn("_d", draw_digest(F.col("kind"), F.col("canon"), F.col("attempt"), key))
    rows = rows.withColumn("_p", _plain(F.col("kind"), F.col("canon"), F.col("_d"), F.col("attempt"), key))
    return rows.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("_d"), F.col("_p"))).drop("_d", "_p")


def _identity(kind: Column, canon: Column, form: Column) -> Column:
    """A surrogate as the canonical form that it would have."""
    return F.when(kind.isin("given", "family"), F.concat(F.regexp_extract(canon, r"^(.*\|)", 1), F.lower(form))).otherwise(form)


def rendered(m: Column, kind: Column, sur: Column, first: Column) -> Column:
    """A canonical surrogate (and, of a name, its first name's) written as the mention was."""
    place = lambda i: F.length(_digits(F.substr(m, F.lit(1), i)))
    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)).rlike("[0-9]"), F.substr(sur, place(i), F.lit(1))).otherwise(F.substr(m, i, F.lit(1)))), "")
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)) == " ", " ").otherwise(F.substr(sur, F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    title, bare, _, _ = _name_parts(m)
    name = F.concat_ws(" ", first, sur)
    shout = m.rlike("[A-Z]") & (F.translate(m, UPPER.lower(), "") == m)
    return (
        F.when(kind.isin("phone", "ssn", "card"), filled).when(kind == "iban", spaced).when(kind == "email", F.when(shout, F.upper(sur)).otherwise(sur))
        .when(kind == "name", F.concat(title, F.when(F.upper(bare) == bare, F.upper(name)).otherwise(name)))
        .otherwise(F.concat(F.regexp_extract(m, f"^(?:{_LABEL})?", 0), sur))
    )


def _found(text: Column) -> Column:
    hint = text.rlike(HINTS[0]) | text.rlike(HINTS[1]) | text.rlike(HINTS[2])
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _mentioned(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the found strings in text order, the pattern that parts the text at them, and for each its kind, its gender if it is a
    name, and its canonical forms."""
    t = F.col(f"`{text}`")
    people = F.filter("__pii_found", lambda m: m.rlike(rf"^(?:{_TITLE})\.? {_WORD}"))

    def person(m: Column) -> Column:
        _, bare, gender, _ = _name_parts(m)
        return F.struct(bare.alias("bare"), F.substring_index(bare, " ", -1).alias("family"), gender.alias("gender"))

    out = docs.withColumn("__pii_found", _found(t)).withColumn("__pii_people", F.transform(people, person))
    names = F.array_distinct(F.concat(*[F.transform("__pii_people", f) for f in (lambda p: p["bare"], lambda p: p["family"], lambda p: F.upper(p["bare"]), lambda p: F.upper(p["family"]))]))
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    again = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))  # names hold letters, hyphens and apostrophes only
    out = out.withColumn("__pii_pattern", F.when(F.size("__pii_people") > 0, again))
    out = out.withColumn("__pii_found", F.when(F.col("__pii_pattern").isNotNull(), F.regexp_extract_all(t, F.col("__pii_pattern"), F.lit(0))).otherwise(F.col("__pii_found")))

    def gender_of(m: Column) -> Column:
        _, bare, own, _ = _name_parts(m)
        said = lambda test: F.element_at(F.transform(F.filter("__pii_people", lambda p: p["gender"].isNotNull() & test(p)), lambda p: p["gender"]), 1)
        known = lambda test: F.when(F.exists("__pii_people", lambda p: p["gender"].isNotNull() & test(p)), said(test))
        return F.coalesce(own, known(lambda p: F.lower(p["bare"]) == F.lower(bare)), known(lambda p: F.lower(p["family"]) == F.lower(F.substring_index(bare, " ", -1))), F.lit("m"))

    out = out.withColumn("__pii_found", F.transform("__pii_found", lambda m: F.struct(m.alias("m"), entity_kind(m).alias("kind"))))
    out = out.withColumn("__pii_found", F.transform("__pii_found", lambda e: _with(e, ("m", "kind"), gender=F.when(e["kind"] == "name", gender_of(e["m"])))))
    return out.withColumn("__pii_found", F.transform("__pii_found", lambda e: _with(e, ("m", "kind"), canon=canonical(e["m"], e["kind"], e["gender"]), first=first_name(e["m"], e["kind"], e["gender"]), sort=F.when(e["kind"] == "name", "family").otherwise(e["kind"]))))


def _entities(mentioned: DataFrame, *keep: str) -> DataFrame:
    """kind, canon (and `keep`): what the mentions of each row name, once a row."""
    both = F.flatten(F.transform("__pii_found", lambda e: F.array(F.struct(e["sort"].alias("kind"), e["canon"].alias("canon")), F.struct(F.lit("given").alias("kind"), e["first"].alias("canon")))))
    return mentioned.select(*keep, F.explode(F.array_distinct(both)).alias("e")).select(*keep, "e.kind", "e.canon").filter("kind is not null and canon is not null")


def checked_entities(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Every different entity of the table with its surrogate: kind, canon, attempt, surrogate; no surrogate twice in a kind,
    none equal to an entity of that kind."""
    key = key or key_of(docs.sparkSession)
    seen = _entities(_mentioned(docs.select(F.col(f"`{text}`")), text)).distinct()
    drawn = materialize(_drawn(seen.withColumn("attempt", F.lit(0)), key), "entities")
    for _ in range(MOST_DRAWS):
        form = _identity(F.col("kind"), F.col("canon"), F.col("surrogate"))
        first = drawn.groupBy("kind", form.alias("form")).agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("kind", "form", F.col("owner.canon").alias("keeper"))
        real = drawn.select("kind", F.col("canon").alias("form")).distinct().withColumn("real", F.lit(True))
        judged = drawn.withColumn("form", form).join(first, ["kind", "form"], "left").join(real, ["kind", "form"], "left")
        again = F.coalesce(F.col("keeper") != F.col("canon"), F.lit(False)) | F.coalesce("real", F.lit(False))
        judged = materialize(judged.select("kind", "canon", "attempt", "surrogate", again.alias("again")), "judged")
        discard(drawn)
        if judged.filter("again").isEmpty():
            return judged.drop("again")
        kept = judged.filter("not again").drop("again")
        drawn = materialize(kept.unionByName(_drawn(judged.filter("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key)), "entities")
        discard(judged)
    full = [r.kind for r in drawn.filter(F.col("attempt") == MOST_DRAWS).select("kind").distinct().collect()]  # a handful of kinds
    raise RuntimeError(f"no distinct surrogates left for {', '.join(sorted(full))} after {MOST_DRAWS} draws")


def with_surrogates(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """`docs` with the text rewritten, `n_entities` and `entity_kinds` (array of the types in text order) added."""
    key = key or key_of(docs.sparkSession)
    t = F.col(f"`{text}`")
    redrawn = checked_entities(docs, text, key).filter("attempt > 0").select(F.concat_ws("|", "kind", "canon").alias("entity"), "attempt")
    out = _mentioned(docs, text)
    if redrawn.isEmpty():
        drawn = lambda kind, canon: F.lit(0)
    else:  # the draws of such entities, by text
        id_ = F.xxhash64(t, F.length(t))
        ids = _entities(_mentioned(docs.select(t, id_.alias("__pii_id")), text), "__pii_id").select("__pii_id", F.concat_ws("|", "kind", "canon").alias("entity")).distinct()
        draws = salted_join(ids, redrawn, ["entity"]).groupBy("__pii_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("__pii_draws"))  # one text's own entities
        out = salted_join(out.withColumn("__pii_id", id_), draws, ["__pii_id"], "left", by=[c for c in docs.columns if c != text][:1]).drop("__pii_id")
        drawn = lambda kind, canon: F.coalesce(F.col("__pii_draws")[F.concat_ws("|", kind, canon)], F.lit(0))

    given = F.lit("given")
    step = lambda fn: out.withColumn("__pii_found", F.transform("__pii_found", fn))
    out = step(lambda e: _with(e, ("m", "kind", "sort", "canon", "first"), at=drawn(e["sort"], e["canon"]), at1=drawn(given, e["first"])))
    out = step(lambda e: _with(e, ("m", "kind", "sort", "canon", "first", "at", "at1"), d=draw_digest(e["sort"], e["canon"], e["at"], key), d1=draw_digest(given, e["first"], e["at1"], key)))
    out = step(lambda e: _with(e, ("m", "kind", "sort", "canon", "first", "d", "d1", "at1"), p=plain_surrogate(e["sort"], e["canon"], e["d"], key)))
    out = step(lambda e: _with(e, ("m", "kind"), s=surrogate(e["sort"], e["canon"], e["d"], e["p"]), s1=F.when(e["first"].isNotNull(), surrogate(given, e["first"], e["d1"], F.when(e["at1"] > 0, "double").otherwise("")))))
    out = step(lambda e: _with(e, ("kind",), to=F.when(e["kind"].isNull(), e["m"]).otherwise(rendered(e["m"], e["kind"], e["s"], e["s1"]))))
    between = F.when(F.col("__pii_pattern").isNotNull(), F.split(t, F.col("__pii_pattern"), -1)).otherwise(F.split(t, PATTERN, -1))
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform("__pii_found", lambda e: e["to"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    kinds = F.array_compact(F.transform("__pii_found", lambda e: e["kind"]))
    changed = F.size("__pii_found") > 0
    out = out.withColumn("entity_kinds", F.when(changed, kinds).otherwise(F.array().cast("array<string>"))).withColumn(text, F.when(changed, joined).otherwise(t))
    names = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    return out.withColumn("n_entities", F.size("entity_kinds")).select(*[f"`{c}`" for c in names], "n_entities", "entity_kinds")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates in the places of personal data."""
    return with_surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data get surrogates; all documents stay."""
    return with_surrogates(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
