"""PII surrogates: keyed, type-consistent replacements, the same for the same entity everywhere.

An entity is its kind and canonical form, so that two notations of a phone number, two spellings of an address' case, or
"Mr John Smith" and "John Smith" are one.  It gets a replacement from a keyed digest: digits for digits, letters for
letters, separators, case and prefixes (the title, `token = "`, the country code) as they stand in the mention;
addresses stay addresses, card numbers keep their first digit and their check digit's validity, names keep title, gender
and script.

Distinctness is checked over all distinct entities: if two share a replacement, or a replacement is itself an entity found
somewhere, all but the smallest take their next candidate (the digest of the next attempt), until none is left.  Every
format grows longer after a few attempts, so that this ends however many entities there are.  Only entities that had
to move on are ever joined back to documents; the others' replacements are computed in the row.

Everything is DataFrame expressions.  One pattern marks all entities in a pass over the text; it is tried at the beginnings
of words only and each alternative fails at its first characters.  Entities are reduced to distinct ones before any shuffle,
so an entity or a text in a third of all documents is one row; texts aren't shuffled, unless the moved mentions are too
many to broadcast (`inline` entries, `inline_bytes` bytes, both checked).

Scope: e-mail addresses, phone numbers (international, with trunk 0, and 3-3-4), IPv4 addresses, card and social security
numbers, IBANs, hexadecimal and prefixed keys, values after `password=` and the like, names after a title or with a
given name of the list.  Other names stay.

Defined cases: null text stays null; empty text stays empty; texts of any length are taken whole; overlapping entities are
told apart from the left, and of equal beginnings the first kind of `PATTERNS` wins; ties of replacements go by attempt and
canonical form; repeated rows each return a row with equal text; an empty table returns no rows; all columns of the input
are returned whatever their names, but for one called `entities`, whose place the result's takes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, unused, written

#: Titles by gender and names by gender and script.
MALE_TITLES, FEMALE_TITLES, TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"), ("Dr", "Prof")
NAMES = {
    ("latin", "m"): ("Adam", "Bruno", "Colin", "Daniel", "Edgar", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Nils", "Oscar", "Paul"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Robin", "Kim", "Sam", "Chris", "Jamie", "Taylor", "Morgan", "Casey", "Jordan", "Lee", "Pat", "Quinn", "Rene", "Sascha", "Toni"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Кира"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Тоня", "Паша", "Рома"),
    ("greek", "m"): ("Άγγελος", "Γιώργος", "Δημήτρης", "Κώστας", "Λεωνίδας", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "f"): ("Αγγελική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
    ("greek", "n"): ("Άρης", "Θέμις", "Λίνος", "Μίνως", "Ρένος", "Τάσος", "Φάνης", "Χάρης"),
}
SYLLABLES = {"latin": ("ba", "den", "fol", "gar", "hel", "kin", "lor", "mas", "nev", "pol", "ren", "sol", "tam", "vik", "wen", "zor"), "cyrillic": ("ба", "ден", "фол", "гар", "хел", "кин", "лор", "мас", "нев", "пол", "рен", "сол", "там", "вик", "вен", "зор"), "greek": ("βα", "δεν", "φολ", "γαρ", "χελ", "κιν", "λορ", "μασ", "νεβ", "πολ", "ρεν", "σολ", "ταμ", "βικ", "ξεν", "ζορ")}
#: Given names that mark a name without a title, beside the longer ones of NAMES.
GIVEN = {
    "m": ("John", "James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Peter", "Hans", "Klaus", "Jürgen", "Stefan", "Pierre", "Jean", "Louis", "Carlos", "José", "Juan", "Luis", "Antonio", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Petra", "Sabine", "Claudia", "Marie", "Sophie", "Carmen", "Lucía", "Elena", "Мария", "Ольга", "Наталья", "Татьяна"),
}
#: What entities look like, in the order in which kinds are tried, all at the beginning of a word.
_TITLE = "|".join(sorted({*MALE_TITLES, *FEMALE_TITLES, *TITLES}, key=len, reverse=True))
_BY_GENDER = {g: sorted({*GIVEN.get(g, ()), *(n for (_, k), v in NAMES.items() if k == g for n in v if len(n) > 3)}) for g in ("m", "f", "n")}
_GIVEN = "|".join(sorted({n for v in _BY_GENDER.values() for n in v}, key=lambda n: (-len(n), n)))
_SECRET = r"""(?=[pPsStTaA])(?i:password|passwd|pwd|secret|token|api[_\-]?key)(?:["']?[=:]["']?|\s{0,3}[=:]\s{0,3}["'])"""
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]{1,256}+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,126}\.[A-Za-z]{2,}",
    "key": r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp|gho|ghs|xox[abp]|sk)[_\-][A-Za-z0-9_\-]{16,})(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "hex": r"(?=[A-Fa-f]{0,127}\d)(?=\d{0,127}[A-Fa-f])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\d\-])",
    "phone": r"(?=[+(\d])(?:\+\d{1,3}[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .\-/]?\d{2,5}){1,4}|\(?0\d{1,4}\)?[ .\-/]\d{3,4}(?:[ .\-/]?\d{2,4}){0,3}|(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4})(?!\d)",
    "name": rf"(?=\p{{Lu}})(?:(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+){{0,2}}|(?:{_GIVEN}) \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}}))",
}
#: Where an entity may begin, and any entity.
_BEGIN = r"(?<![\p{L}\p{N}+])"
ANY = _BEGIN + "(?:" + "|".join([_SECRET + r"[^\s\"',;<>]+", *PATTERNS.values()]) + ")"
_OPEN, _CLOSE = "\x01", "\x02"


def kind_of(entity: Column) -> Column:
    """The kind by the entity alone, tried in order; what fits none is a password."""
    out = None
    for kind, p in PATTERNS.items():
        test = entity.rlike(rf"\A(?:{p})\z")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("password")


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^0-9]", "")


def _gender(title: Column, name: Column) -> Column:
    """By the title, else by the given name."""
    given = F.regexp_extract(name, r"^(\p{L}+) ", 1)
    by_name = F.when(given.isin(*_BY_GENDER["m"]), "m").when(given.isin(*_BY_GENDER["f"]), "f").otherwise("n")
    return F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise(by_name)


def canonical(entity: Column, kind: Column, prefix: Column) -> Column:
    """What must agree for two mentions to be one entity.  entity: without its prefix."""
    digits = _digits(entity)
    phone = F.when(entity.startswith("+1") & (F.length(digits) == 11), F.right(digits, F.lit(10))).when(entity.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    name = F.concat(_gender(F.regexp_extract(prefix, rf"^({_TITLE})", 1), entity), F.lit("|"), entity)
    return F.when(kind.isin("email", "hex"), F.lower(entity)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "name", name).otherwise(entity)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row: inside lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hexadecimal digits under the key."""
    inner = F.sha2(F.concat(key, F.lit("\0in\0"), kind, F.lit("\0"), canon, F.lit("\0"), attempt.cast("string")), 512)
    return F.sha2(F.concat(key, F.lit("\0out\0"), inner), 512)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, 2 * F.pmod(i, F.lit(64)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")


def _values(values: tuple[str, ...]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(" ".join(values)), " ")


def _pick(values: Column, n: Column) -> Column:
    return F.get(values, F.pmod(n, F.size(values)).cast("int"))


def _by_class(text: Column, digest: Column, letters: int = 26) -> Column:
    """Digit for digit, letter for letter of its case; everything else as it is."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike("[A-Z]"), F.char(65 + F.pmod(b, F.lit(letters)))).when(c.rlike(r"\p{L}"), F.char(97 + F.pmod(b, F.lit(letters)))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _drawn(n: Column, digest: Column) -> Column:
    """n digits."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.pmod(_byte(digest, i), F.lit(10)).cast("string")), "")).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Sum of a digit string whose last digit is the check digit's place."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        x = c.cast("int")
        twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return F.when((n - 1 - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda s, x: s + x)


def _new_digits(canon: Column, kind: Column, digest: Column, room: Column) -> Column:
    """As many digits (and `room` more); phones keep country code or trunk 0, cards their first digit and their validity."""
    head = F.when(kind == "phone", F.regexp_extract(canon, rf"^(\+(?:{_COUNTRY})|0)", 1)).otherwise("")
    card = F.concat(F.substring(canon, 1, 1), _drawn(F.length(canon) - 2 + room, digest))
    check = F.pmod(10 - _luhn_sum(F.concat(card, F.lit("0"))) % 10, F.lit(10))
    valid = _luhn_sum(canon) % 10 == 0
    last = F.when(valid, check).otherwise(F.pmod(check + 1 + F.pmod(_byte(digest, F.lit(40)), F.lit(9)), F.lit(10)))
    return F.when(kind == "card", F.concat(card, last.cast("string"))).otherwise(F.concat(head, _drawn(F.length(canon) - F.length(head) + room, digest)))


def _name(canon: Column, digest: Column, attempt: Column) -> Column:
    """canon is gender|name, and so is the result; from the fourth attempt on its end is a syllable longer each time."""
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.substring(canon, 1, 1)
    names = reduce(lambda out, k: out.when(F.concat(script, gender) == "".join(k), _values(NAMES[k])), NAMES, F.when(F.lit(False), _values(("",))))
    syllables = reduce(lambda out, k: out.when(script == k, _values(SYLLABLES[k])), SYLLABLES, F.when(F.lit(False), _values(("",))))

    def written_out(of: Column) -> Column:
        made = lambda first, n: F.array_join(F.transform(F.sequence(first, first + n - 1), lambda i: _pick(of, _byte(digest, i))), "")
        family = lambda at: F.initcap(made(F.lit(at), F.lit(4)))
        parts = F.size(F.split(canon, "[ -]"))
        given = F.concat(_pick(names, _byte(digest, F.lit(0))), F.lit(" "))
        whole = F.concat(F.when(parts > 1, given).otherwise(""), family(1), F.when(parts > 2, F.concat(F.lit(" "), family(7))).otherwise(""))
        return F.concat(gender, F.lit("|"), whole, F.when(attempt > 3, made(F.lit(14), attempt - 3)).otherwise(""))

    return _let(syllables, written_out)


def canonical_surrogate(kind: Column, canon: Column, attempt: Column, key: Column) -> Column:
    """The replacement of an entity's canonical form.  Where a format is too small for all its entities, later attempts are longer."""
    return _let(_digest(key, kind, canon, attempt), lambda d: _by_kind(kind, canon, attempt, d))


def _by_kind(kind: Column, canon: Column, attempt: Column, d: Column) -> Column:
    short, long = F.greatest(attempt - 3, F.lit(0)), F.greatest(attempt - 7, F.lit(0))
    port = F.when(long > 0, F.concat(F.lit(":"), F.lit("1"), _drawn(F.least(long, F.lit(4)), F.reverse(d)))).otherwise("")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(_byte(d, i) * 251 + _byte(d, i + 9), F.lit(254))).cast("string")), ".")
    kept = lambda n: F.concat(F.substring(canon, 1, n), _by_class(F.concat(F.substring(canon, F.lit(n + 1), F.length(canon)), F.repeat(F.lit("0"), long)), d))
    end = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    mail = F.concat(_by_class(F.concat(F.substring(canon, F.lit(1), F.length(canon) - F.length(end)), F.repeat(F.lit("a0"), short)), d), end)
    return (
        F.when(kind == "email", mail).when(kind == "ip", F.concat(octets, port)).when(kind == "key", kept(4)).when(kind == "iban", kept(2)).when(kind == "hex", _by_class(F.concat(canon, F.repeat(F.lit("0"), long)), d, 6))
        .when(kind.isin("phone", "card", "ssn"), _new_digits(canon, kind, d, long)).when(kind == "name", _name(canon, d, attempt)).otherwise(_by_class(F.concat(canon, F.repeat(F.lit("a0"), short)), d))
    )


def _laid_out(entity: Column, kind: Column, canon: Column, made: Column) -> Column:
    """The canonical replacement in the mention's own format."""
    chars = F.split(entity, "")
    spot = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
    digits = F.when(kind == "iban", made).otherwise(_digits(made))
    own = F.when(kind == "iban", F.length(canon)).otherwise(F.length(_digits(canon)))
    before = F.when(kind == "iban", F.lit(0)).otherwise(F.length(_digits(entity)) - own)
    count = lambda text: F.when(kind == "iban", F.length(F.replace(text, F.lit(" "), F.lit("")))).otherwise(F.length(_digits(text)))

    def put(c: Column, i: Column) -> Column:
        at = count(F.substring(entity, F.lit(1), i)) - before
        return F.when(F.regexp_like(c, spot) & (at >= 0), F.substring(digits, at + 1, F.lit(1))).otherwise(c)

    filled = F.concat(F.array_join(F.transform(chars, put), ""), F.substring(digits, own + 1, F.length(digits)))
    by_case = F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.get(chars, i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "name", F.substring(made, F.lit(3), F.length(made))).when(kind.isin("email", "hex") & (entity != F.lower(entity)), by_case).otherwise(made)


def segments(text: Column) -> Column:
    """What is between entities and, at odd places, the entities; null of null."""
    marked = F.split(F.regexp_replace(text, ANY, _OPEN + "$0" + _CLOSE), f"[{_OPEN}{_CLOSE}]", -1)
    # A text that has the marks itself is searched twice instead.
    found = F.concat(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), F.array(F.lit("")))
    apart = F.flatten(F.zip_with(F.split(text, ANY, -1), found, lambda a, b: F.array(a, b)))
    return F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.slice(apart, F.lit(1), F.size(apart) - 1)).otherwise(marked)


_ENTITIES = "array<struct<prefix:string,entity:string,kind:string,canon:string>>"


def entities(parts: Column) -> Column:
    """array of struct(prefix, entity, kind, canon) in order, of segments."""
    odd = F.filter(parts, lambda x, i: i % 2 == 1)
    cut = F.transform(odd, lambda e: F.struct(F.regexp_extract(e, rf"\A({_SECRET}|(?:{_TITLE})\.? )", 1).alias("prefix"), e.alias("whole")))
    bare = F.transform(cut, lambda e: F.struct(e["prefix"].alias("prefix"), F.substring(e["whole"], F.length(e["prefix"]) + 1, F.length(e["whole"])).alias("entity"), e["whole"].alias("whole")))
    kind = lambda e: F.when(e["prefix"].rlike(rf"\A(?:{_TITLE})"), "name").otherwise(kind_of(e["entity"]))
    known = F.transform(bare, lambda e: F.struct(e["prefix"].alias("prefix"), e["entity"].alias("entity"), kind(e).alias("kind")))
    return F.coalesce(F.transform(known, lambda e: F.struct(e["prefix"].alias("prefix"), e["entity"].alias("entity"), e["kind"].alias("kind"), canonical(e["entity"], e["kind"], e["prefix"]).alias("canon"))), F.array().cast(_ENTITIES))


def keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a column derived from the key.  It comes from a table of one row, so that no plan, UI or event log has it as a literal."""
    derived = hashlib.sha256(b"surrogates\0" + key.encode()).hexdigest()
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(derived,)], f"{name} string")))


def moved_entities(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt (over 0), a written table: entities whose first replacement isn't theirs alone.  found: kind, canon."""
    own = written(found.distinct(), "entities")
    state = written(own.withColumn("attempt", F.lit(0)), "attempts")
    next_one = canonical_surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("secret")).alias("made")
    while True:
        made = written(keyed(state, key, "secret").select("kind", "canon", "attempt", next_one), "surrogates")
        # Who keeps a shared replacement: the earliest attempt, then the smallest form.
        keeper = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "made", F.col("keeper.canon").alias("keeper"))
        taken = own.select("kind", F.col("canon").alias("made"), F.lit(True).alias("taken"))
        clash = made.join(keeper, ["kind", "made"], "left").join(taken, ["kind", "made"], "left")
        bad = F.coalesce("taken", F.lit(False)) | F.coalesce(F.col("keeper") != F.col("canon"), F.lit(False))
        after = written(clash.select("kind", "canon", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad")), "attempts")
        dropped(made, state)
        state = after
        if not state.where("bad").limit(1).count():
            out = written(state.where("attempt > 0").select("kind", "canon", "attempt"), "moved")
            dropped(own, state)
            return out


def pseudonymize(docs: DataFrame, *, key: str, text: str = "text", inline: int = 200_000, inline_bytes: int = 32_000_000) -> DataFrame:
    """docs with entities in `text` replaced, and `entities` (array of struct(kind, surrogate)) in order."""
    parts, found, row, moved, new, secret = (unused(docs.columns, n) for n in ("parts", "found", "row", "moved", "new", "secret"))
    listed = docs.where(F.col(text).isNotNull()).select(segments(F.col(text)).alias("p")).where(F.size("p") > 1)
    every = listed.select(F.explode(entities(F.col("p"))).alias("e")).select("e.kind", "e.canon")
    changed = moved_entities(every, key)
    rows = docs.withColumn(parts, segments(F.col(text))).withColumn(found, entities(F.col(parts)))
    if changed.limit(1).count():
        # Distinct mentions of moved entities by text: a text repeated in many rows is one key.
        own = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias(row), segments(F.col(text)).alias("p")).where(F.size("p") > 1)
        mentioned = own.select(row, F.explode(entities(F.col("p"))).alias("e")).select(row, F.col("e.kind").alias("kind"), F.col("e.canon").alias("canon"))
        size = changed.agg(F.count(F.lit(1)), F.sum(F.octet_length("canon"))).first()
        small = size[0] <= inline and size[1] <= inline_bytes
        met = mentioned.join(F.broadcast(changed) if small else changed, ["kind", "canon"]).distinct()
        each = written(met.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\0"), "canon").alias("k"), "attempt"))).alias(moved)), "mentions")
        size = each.agg(F.sum(F.size(moved)), F.sum(F.octet_length(F.array_join(F.map_keys(moved), "")))).first()
        small = (size[0] or 0) <= inline and (size[1] or 0) <= inline_bytes
        rows = rows.withColumn(row, F.xxhash64(F.col(text))).join(F.broadcast(each) if small else each, row, "left")
    else:
        rows = rows.withColumn(moved, F.lit(None).cast("map<string,int>"))
        dropped(changed)

    def surrogate(e: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(moved, F.concat(e["kind"], F.lit("\0"), e["canon"])), F.lit(0))
        return F.concat(e["prefix"], _laid_out(e["entity"], e["kind"], e["canon"], canonical_surrogate(e["kind"], e["canon"], attempt, F.col(secret))))

    rows = keyed(rows, key, secret).withColumn(new, F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), surrogate(e).alias("surrogate"))))
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.get(F.col(new), ((i - 1) / 2).cast("int"))["surrogate"]).otherwise(x)), "")
    names = [F.when(F.size(parts) > 1, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns if c != "entities"]
    return rows.select(*names, F.col(new).alias("entities"))
