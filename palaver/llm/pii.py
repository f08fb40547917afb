"""Surrogates for personal data (3), in DataFrame operations only.

Entities: e-mail, IPv4 and IPv6 addresses, phone, card, social security and
passport numbers, IBANs, credentials after ``password=`` and the like, keys of
known prefixes, names after a title, names that begin with a common first name,
and the other mentions of such names in the same document.  Names of neither kind
in their document are not found.  Each is replaced by a keyed surrogate of its type:

* format: digits stay digits, letters letters, separators, case and length of
  the occurrence are kept; cards keep a valid Luhn digit, IBANs valid check
  digits and their country, phones their country code and trunk zero, keys their
  prefix, addresses their top-level domain;
* gender and script: a name is a woman's by its title, or else by its first name,
  and gets a first name formed as women's names are; Cyrillic and Greek names stay
  in their script, and Cyrillic surnames keep the ending of their gender;
* coreference: the surrogate depends on the key, the type and the normalised
  entity alone, so all spellings of one number and all mentions found of one
  name agree over the whole corpus (first names by gender; parts of double names
  each for themselves; a surname in both genders); e-mail domains agree as well;
  initials get another letter;
* distinctness: all surrogates of the corpus are checked against each other and
  against the real entities; the later entity of a collision draws again.

The key comes from the setting ``spark.palaver.pii.key``; without one a new key is
drawn for each call, so surrogates of two calls do not agree and nobody can rebuild them.

Texts are cut at entities, so nothing else in them changes.  Texts without
entities pass unchanged and are not shuffled.

Defined results: null and empty texts are unchanged, with no entities.  Repeated
rows give repeated results.  Nulls and other columns are passed through; helper
columns are named with a leading ``_pii_``.  An empty table has an empty result;
texts and entities of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, guarded, hot_left_join

KEY_SETTING = "spark.palaver.pii.key"
MOST_ROUNDS = 40

# The patterns of the entities.
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Dame|Frau|Fräulein|Señora|Señorita|Sra|Srta|Doña|Dña|Doctora|Dra|Profesora|Madame|Mademoiselle|Mme|Mlle|[Гг]оспожа|[Гг]-жа|Κυρία|Κα"
MALE = "Mr|Mister|Sir|Lord|Herr|Señor|Sr|Don|Monsieur|MM?(?=\\.)|[Гг]осподин|[Гг]-н|Κύριος|Κος"
#: Titles that do not tell.
NEUTRAL = "Dr|Doctor|Prof|Professor|Doktor|Profesor|Docteur|Professeur|[Дд]октор|[Пп]рофессор"
# Common first names.
WOMEN = "Alice|Amy|Ana|Angela|Anna|Anne|Barbara|Beatriz|Carmen|Catherine|Chantal|Charlotte|Claire|Clara|Elena|Elizabeth|Emily|Emma|Eva|Fatima|Francesca|Giulia|Hannah|Heike|Helen|Ingrid|Isabel|Jane|Jennifer|Jessica|Julia|Karen|Katharina|Laura|Linda|Lisa|Lucia|Margaret|Maria|María|Marie|Mary|Monika|Nancy|Natalia|Olga|Patricia|Petra|Rachel|Rebecca|Rosa|Ruth|Sabine|Sandra|Sarah|Sofia|Sophie|Susan|Svetlana|Tatiana|Ursula|Анна|Елена|Екатерина|Ирина|Мария|Наталья|Ольга|Светлана|Татьяна|Юлия|Ελένη|Κατερίνα|Μαρία|Σοφία"
MEN = "Adam|Ahmed|Alan|Alejandro|Alexander|Andrew|Antonio|Benjamin|Bernd|Carlos|Charles|Christopher|Daniel|David|Diego|Edward|Eric|Fernando|Francisco|Frank|François|George|Giovanni|Hans|Henry|Ivan|Jacques|James|Javier|Jean|Johann|John|Jorge|José|Joseph|Juan|Jürgen|Karl|Kevin|Klaus|Luis|Manuel|Mario|Martin|Matthew|Michael|Miguel|Mohammed|Nicolas|Oliver|Pablo|Paul|Pedro|Peter|Philippe|Pierre|Richard|Robert|Stefan|Steven|Thomas|Vladimir|Walter|William|Wolfgang|Александр|Алексей|Андрей|Борис|Дмитрий|Иван|Михаил|Николай|Сергей|Юрий|Γιώργος|Γιάννης|Δημήτρης|Νίκος"
NAME = r"\p{Lu}[\p{L}\p{M}'’\-]++"
INITIAL = r"\p{Lu}\."
#: Small words inside a name.
LINK = "(?:de|del|la|las|los|le|du|des|da|do|dos|di|y|van|von|der|den|zu|zur|bin|ibn|al)"
#: A part of a name that gets a surrogate: a run of letters from a capital on.
RUN = r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]+"
def _by_first(names: str) -> str:
    """The same alternatives, tried by their first letter."""
    of: dict[str, list[str]] = {}
    for name in names.split("|"):
        first = name[: name.index("]") + 1] if name.startswith("[") else name[0]
        of.setdefault(first, []).append(name[len(first) :])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in of.items())


TITLED = rf"(?:{_by_first(f'{FEMALE}|{MALE}|{NEUTRAL}')})\.? (?:{INITIAL} )*+{NAME}(?: (?:(?:{LINK} )*+{NAME}|{INITIAL}))*+"
CALLED = rf"(?:{_by_first(f'{WOMEN}|{MEN}')})(?:-{NAME})? (?:{INITIAL} )*+(?:{LINK} )*+{NAME}(?: (?:(?:{LINK} )*+{NAME}|{INITIAL}))*+"
#: What may stand beside a name's word elsewhere in its document.
ALONE = (r"(?<![\p{L}\p{M}\p{N}_])(?:", r")(?![\p{L}\p{M}\p{N}_])")
#: Begins what is found as a later mention, before its kind and the word; no pattern takes it in.
LATER = "\x01"
#: The whole value, of any length, but for points that end a sentence; what has no letter or digit has no surrogate.
VALUE = r"(?=[_\-/+.=~]*+[A-Za-z0-9])[A-Za-z0-9_\-/+.=~]{7,}[A-Za-z0-9_\-/+=~]"
KEYS = r"(?:A[KS]IA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-)"
H16 = "[0-9A-Fa-f]{1,4}"
PASSPORT = r"[A-Z]{0,2}\d{6,9}"
#: Country codes of telephone numbers: of one digit, of two, else of three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}+",
    "secret": r"(?=[PpSsTtAa])(?<![A-Za-z])(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY) ?[=:] ?[\"']?" + VALUE,
    "key": rf"(?=[AgsSx])(?<![\p{{L}}\p{{N}}_\-]){KEYS}[A-Za-z0-9_\-]{{16,}}+",
    "passport": rf"(?=[PpRП])(?<!\p{{L}})(?:[Pp]ass(?:port|eport|aporte)|[Pp]asaporte|Reisepass|[Пп]аспорт)(?: ?(?:[Nn]o\.?|[Nn]umber|[Nn][úu]mero|[Nn]um[ée]ro|[Nn]r\.?|[Nn]ummer|№))?:? ?#?{PASSPORT}(?![\p{{L}}\p{{N}}])",
    "ipv6": rf"(?=[0-9A-Fa-f:])(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*\d)(?:(?:{H16}:){{7}}{H16}|(?:{H16}(?::{H16}){{0,6}})?::(?:{H16}(?::{H16}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "ip": r"(?=\d)(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)",
    "card": r"(?=\d)(?<!\d)(?:\d{4}[ \-]?){3}\d{4}(?!\d)",
    "ssn": r"(?=\d)(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?=\+)(?<![\d+])\+\d{1,3}[ .\-]?\(0\)[ .\-]?\d{1,5}(?:[ .\-]?\d{2,5}){1,4}(?!\d)"
    r"|(?=[\d+(])(?<![\d+(])(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\d)"
    r"|(?=\+)(?<![\d+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)|(?=\+)(?<![\d+])\+\d{10,14}(?!\d)"
    r"|(?=[2-9])(?<![\p{L}\p{N}_.,\-])[2-9]\d{2}[2-9]\d{6}(?![\p{L}\p{N}_\-]|[.,]\d)",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?=[A-ZА-ЯΑ-Ωгдп])(?<![\p{{L}}\p{{M}}\p{{N}}_\-])(?:{TITLED}|{CALLED})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
OTHERS = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "name")
#: Every entity but a name has one of these; the cheap test spares most texts the long one.
SIGNS = "[0-9@=:]"
#: What a known prefix of a key holds.
PREFIXES = ("AKIA", "ASIA", "AIza", "gh", "glpat-", "sk-", "xox")
LATIN = ["ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu", "ze"]
CYRILLIC = ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "це"]
GREEK = ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "νε", "πα", "ρε", "σι", "το", "φα", "χε", "ψι"]
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def secret_key(spark: SparkSession) -> str:
    """The key of the setting, or one drawn for this call."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def _rest(raw: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(raw, rf"^(?:{FEMALE}|{MALE}|{NEUTRAL})\.? (?=\p{{L}})", "")


def _gender(raw: Column) -> Column:
    """``_f`` or ``_m``, of a name: by its title, else by its first name."""
    woman = raw.rlike(rf"^(?:{FEMALE})\.? \p{{Lu}}") | ~raw.rlike(rf"^(?:{MALE})\.? \p{{Lu}}") & _rest(raw).rlike(rf"^(?:{WOMEN})(?![\p{{L}}\p{{M}}])")
    return F.when(woman, "_f").otherwise("_m")


def _kind(raw: Column) -> Column:
    """Type of a matched string."""
    out = F.when(raw.startswith(LATER), F.substring_index(F.substring(raw, 2, 20), LATER, 1))
    for kind in ("secret", "key", "passport"):
        out = out.when(raw.rlike("^(?:" + PATTERNS[kind] + ")$"), kind)
    out = out.when(raw.contains("@"), "email").when(raw.rlike(r"^\p{L}\D*$") & ~raw.contains(":"), F.concat(F.lit("name"), _gender(raw)))
    for kind in ("ipv6", "ip", "ssn", "card", "iban"):
        out = out.when(raw.rlike("^(?:" + PATTERNS[kind] + ")$"), kind)
    return out.when(raw.rlike(r"^\+(?!1\D|1\d{10}$)"), "abroad").otherwise("phone")


def _tail(raw: Column) -> Column:
    """A credential without what names it."""
    return F.regexp_replace(raw, r"^[A-Za-z_\-]+ ?[=:] ?[\"']?", "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _runs(rest: Column) -> Column:
    return F.regexp_extract_all(rest, F.lit(RUN), F.lit(0))


def _name_parts(raw: Column) -> Column:
    """(kind, word) of the parts of a name: those of its first word, if there are more, and of the others."""
    rest = _rest(raw)
    words = F.filter(F.split(rest, " "), lambda w: w.rlike(r"^\p{Lu}[^.]"))
    first = F.when(F.size(words) > 1, F.size(_runs(words[0]))).otherwise(0)
    gender = F.concat(F.lit("first"), _gender(raw))
    return F.transform(_runs(rest), lambda w, i: F.struct(F.when(i < first, gender).otherwise("surname").alias("kind"), w.alias("word")))


def _norm(kind: Column, word: Column) -> Column:
    """A name's part in small letters; a Cyrillic woman's surname as the man's."""
    low = F.lower(word)
    man = F.regexp_replace(F.regexp_replace(low, "([оеё]в|[иы]н)а$", "$1"), "([сц]к)ая$", "$1ий")
    return F.when((kind == "surname") & low.rlike(r"\p{IsCyrillic}"), man).otherwise(low)


def _parts(raw: Column, kind: Column) -> Column:
    """The normalised entities of a match: (kind, norm), one for each part of a name."""
    number = _digits(raw)
    phone = F.when((F.length(number) == 11) & number.startswith("1"), F.substring(number, 2, 10)).otherwise(number)
    norm = (
        F.when(raw.startswith(LATER), _norm(kind, F.substring_index(raw, LATER, -1)))
        .when(kind.isin("email", "ipv6"), F.lower(raw)).when(kind == "secret", _tail(raw)).when(kind.isin("key", "ip"), raw)
        .when(kind == "passport", F.regexp_extract(raw, PASSPORT + "$", 0))
        .when(kind == "phone", phone).when(kind == "abroad", _digits(F.replace(raw, F.lit("(0)"), F.lit(""))))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).otherwise(number)
    )
    names = F.transform(_name_parts(raw), lambda p: F.struct(p["kind"].alias("kind"), _norm(p["kind"], p["word"]).alias("norm")))
    return F.when(kind.startswith("name"), names).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"))))


def _mentions(text: Column) -> Column:
    """(word, kind) of the names in a text, as they and in capitals may stand elsewhere in it."""
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), _name_parts))
    found = F.array_distinct(F.filter(found, lambda p: F.length(p["word"]) > 1))
    forms = F.transform(found, lambda p: F.array(*[F.struct(w.alias("word"), p["kind"].alias("kind")) for w in (p["word"], F.upper(p["word"]), F.initcap(p["word"]))]))
    return F.array_distinct(F.flatten(forms))


def _pattern(mentions: Column) -> Column:
    """ANY, and the words of ``mentions`` wherever they stand alone."""
    words = F.array_join(F.array_distinct(F.transform(mentions, lambda m: m["word"])), "|")
    return F.when(F.size(mentions) > 0, F.concat(F.lit(ANY + "|" + ALONE[0]), words, F.lit(ALONE[1]))).otherwise(ANY)


def _stream(h: Column) -> Column:
    """60 decimal digits of a hex hash of 64."""
    return F.concat(*[F.right(F.lpad(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10), 20, "0"), F.lit(15)) for k in range(4)])


def _fill(shape: Column, h: Column, letters: str = LETTERS) -> Column:
    """``shape`` with its digits and letters drawn anew; case and all else stay."""
    digits = _stream(h)
    drawn = F.translate(h, DIGITS + "abcdef", "kqwxzjyvgp" + "bdhmrt") if letters == LETTERS else F.translate(h, DIGITS, "bcdeafbcde")

    def one(c: Column, i: Column) -> Column:
        letter = F.substring(drawn, F.pmod(i, F.lit(60)) + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), F.substring(digits, F.pmod(i, F.lit(60)) + 1, F.lit(1)))
            .when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _luhn(body: Column) -> Column:
    """``body`` and its check digit, body of odd length."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.filter(F.transform(F.split(body, ""), value), lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v)
    return F.concat(body, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _iban(country: Column, body: Column) -> Column:
    """Country, check digits by the remainder modulo 97, body."""

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + LETTERS.upper()), c) - 1
        return F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")

    chars = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    return F.concat(country, F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0"), body)


def _name(h: Column, norm: Column, attempt: Column, syllables: int, ends: tuple[str, str, str]) -> Column:
    """A name of syllables in the norm's script; more of them the more often it was drawn."""

    def build(parts: list[str], end: str) -> Column:
        table = F.array(*[F.lit(p) for p in parts])
        at = F.sequence(F.lit(1), F.least(F.lit(syllables) + attempt, F.lit(30)))
        drawn = F.transform(at, lambda i: F.element_at(table, F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int") + 1))
        return F.concat(F.array_join(drawn, ""), F.lit(end))

    other = F.when(norm.rlike(r"\p{IsGreek}"), build(GREEK, ends[2])).otherwise(build(LATIN, ends[0]))
    return F.when(norm.rlike(r"\p{IsCyrillic}"), build(CYRILLIC, ends[1])).otherwise(other)


def _octet(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 4), 16, 10).cast("int")


def _core(key: str) -> Column:
    """Surrogate of (kind, norm, attempt)."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm), 256)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    at_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    host = F.concat(_fill(F.substring_index(domain, ".", 1), at_domain), F.lit(".example."), F.substring_index(domain, ".", -1))
    stream = _stream(h)
    prefix, code = F.regexp_extract(norm, "^" + KEYS, 0), F.regexp_extract(norm, COUNTRY, 0)
    lead = (F.pmod(_octet(h, 1), F.lit(8)) + 2).cast("string")
    ip = F.concat_ws(".", (F.pmod(_octet(h, 1), F.lit(223)) + 1).cast("string"), *[F.pmod(_octet(h, k), F.lit(256)).cast("string") for k in (5, 9, 13)])
    return (
        F.when(kind == "email", F.concat(_fill(local, h), F.lit("@"), host))
        .when(kind == "ip", ip)
        .when(kind == "card", _luhn(F.concat(F.substring(norm, 1, 1), F.substring(stream, 1, 14))))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(stream, 1, 8)))
        .when(kind == "iban", _iban(F.substring(norm, 1, 2), _fill(F.expr("substring(norm, 5)"), h)))
        .when(kind == "secret", F.when(norm.rlike("^[0-9a-f]+$"), _fill(norm, h, "abcdef")).otherwise(_fill(norm, h)))
        .when(kind == "ipv6", _fill(norm, h, "abcdef")).when(kind == "passport", _fill(norm, h))
        .when(kind == "key", F.concat(prefix, _fill(F.substring(norm, F.length(prefix) + 1, F.length(norm)), h)))
        .when(kind == "abroad", F.concat(code, _fill(F.substring(norm, F.length(code) + 1, F.length(norm)), h)))
        .when(kind == "first_f", _name(h, norm, attempt, 3, ("na", "на", "να")))
        .when(kind == "first_m", _name(h, norm, attempt, 3, ("rn", "н", "νος")))
        .when(kind == "surname", _name(h, norm, attempt, 4, ("n", "ов", "ης")))
        .otherwise(F.concat(lead, F.substring(_fill(norm, h), F.lit(2), F.lit(64))))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, core, attempt) for distinct (kind, norm), free of collisions.

    A surrogate taken by an entity of fewer draws, or equal to a real entity of
    its kind, is drawn again; each round settles all but a sliver.
    """
    now = cut(entities.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("core", _core(key)))
    real = entities.select("kind", F.col("norm").alias("core"), F.lit(True).alias("real"))
    for _ in range(MOST_ROUNDS):
        owners = now.groupBy("kind", "core").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("n"))
        clash = owners.join(real, ["kind", "core"], "left").filter((F.col("n") > 1) | F.col("real"))
        clash = cut(clash.select("kind", "core", "owner", F.coalesce("real", F.lit(False)).alias("real")))
        if clash.isEmpty():
            return now.select("kind", "norm", "core", "attempt")
        again = F.col("owner").isNotNull() & (F.col("real") | (F.struct("attempt", "norm") != F.col("owner")))
        moved = now.join(clash, ["kind", "core"], "left").select("kind", "norm", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.when(~F.coalesce(again, F.lit(False)), F.col("core")).alias("core"))
        now = cut(moved.withColumn("core", F.coalesce("core", _core(key))))
    raise RuntimeError("surrogates still collide")


def _called(word: Column, core: Column) -> Column:
    """A surrogate in the case and gender of the word it stands for."""
    low = F.lower(word)
    woman = low.rlike("(?:[оеё]в|[иы]н)а$|[сц]кая$") & core.endswith("ов")
    own = F.when(woman, F.concat(core, F.lit("а"))).otherwise(core)
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(own)).otherwise(F.initcap(own))


def _initials(key: str) -> tuple[str, str]:
    """Capitals, and the others of their script that stand for them: one to one, none for itself."""
    given = drawn = ""
    for letters in ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", LETTERS.upper()):
        ring = "".join(sorted(letters, key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest()))
        given, drawn = given + ring, drawn + ring[1:] + ring[0]
    return given, drawn


def _format(raw: Column, kind: Column, cores: Column, key: str) -> Column:
    """The surrogates in the form of the occurrence."""
    core = F.element_at(cores, 1)
    sign = "[^A-Za-z0-9]"
    # the trunk zero is no sign of the number
    shape = F.replace(raw, F.lit("(0)"), F.lit("(\x02)"))
    # leading signs beyond the core's length (a country code) stay
    lead = F.length(F.regexp_replace(shape, sign, "")) - F.length(core)

    def one(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), sign, "")) - lead
        return F.when(c.rlike("^[A-Za-z0-9]$") & (k >= 0), F.substring(core, k + 1, F.lit(1))).otherwise(c)

    spread = F.replace(F.array_join(F.transform(F.split(shape, ""), one), ""), F.lit("\x02"), F.lit("0"))
    shout = (raw == F.upper(raw)) & (raw != F.lower(raw))
    rest = _rest(raw)

    initial = lambda c: F.translate(c, *_initials(key))

    def between(gap: Column) -> Column:
        chars = F.split(gap, "")
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\p{Lu}$") & (F.get(chars, i + 1) == "."), initial(c)).otherwise(c)), "")

    def named(own: Column) -> Column:
        pieces = F.transform(own["runs"], lambda w, i: F.concat(between(F.get(own["gaps"], i)), _called(w, F.get(own["cores"], i))))
        return F.concat(F.array_join(pieces, ""), between(F.element_at(own["gaps"], -1)))

    # an array of one, so that its parts are made once a name and not once a run
    parts = F.struct(_runs(rest).alias("runs"), F.split(rest, RUN, -1).alias("gaps"), cores.alias("cores"))
    name = F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(rest)), F.transform(F.array(parts), named)[0])
    return (
        F.when(raw.startswith(LATER), _called(F.substring_index(raw, LATER, -1), core))
        .when(kind.isin("email", "ipv6"), F.when(shout, F.upper(core)).otherwise(core))
        .when(kind.isin("ip", "key"), core)
        .when(kind.isin("secret", "passport"), F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(core)), core))
        .when(kind.startswith("name"), name)
        .otherwise(spread)
    )


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All rows of ``docs`` with surrogates in ``text``, and ``_pii_n``, the number of entities."""
    key = key or secret_key(docs.sparkSession)
    names = docs.columns
    text = F.col("text")
    signs = text.rlike(SIGNS)
    for prefix in PREFIXES:
        signs |= text.contains(prefix) & text.rlike(PATTERNS["key"])
    has = F.coalesce((signs & text.rlike(OTHERS)) | text.rlike(PATTERNS["name"]), F.lit(False))
    clean = docs.filter(~has).withColumn("_pii_n", F.lit(0).cast("long"))

    def marked(raw: Column) -> Column:
        kind = F.get(F.filter("_pii_names", lambda m: m["word"] == raw), 0)["kind"]
        return F.when(kind.isNotNull(), F.concat(F.lit(LATER), kind, F.lit(LATER), raw)).otherwise(raw)

    dirty = cut(
        docs.filter(has).withColumn("_pii_names", F.when(text.rlike(PATTERNS["name"]), _mentions(text)).otherwise(F.array().cast("array<struct<word: string, kind: string>>")))
        .withColumn("_pii_pattern", _pattern(F.col("_pii_names")))
        .withColumn("_pii_raw", F.transform(F.regexp_extract_all("text", F.col("_pii_pattern"), F.lit(0)), marked))
        .withColumn("_pii_pattern", F.when(F.size("_pii_names") > 0, F.col("_pii_pattern"))).drop("_pii_names")
        .withColumn("_pii_key", F.sha2("text", 256))
    )
    texts = cut(dirty.groupBy("_pii_key").agg(F.first("_pii_raw").alias("raws"), F.count("*").alias("n")))
    spots = texts.select("_pii_key", F.posexplode("raws").alias("pos", "raw"))
    # kinds are materialised, as every branch of what follows asks for them
    kinds = cut(spots.groupBy("raw").agg(F.count("*").alias("n")).withColumn("kind", _kind(F.col("raw"))))
    raws = cut(kinds.withColumn("parts", _parts(F.col("raw"), F.col("kind"))))
    entities = cut(raws.select(F.explode("parts").alias("p")).select("p.kind", "p.norm").distinct())
    cores = surrogates(entities, key).drop("attempt")
    new = (
        raws.select("raw", "n", F.col("kind").alias("whole"), F.posexplode("parts").alias("at", "p"))
        .select("raw", "n", "whole", "at", "p.kind", "p.norm").join(cores, ["kind", "norm"])
        .groupBy("raw", "n", "whole").agg(F.array_sort(F.collect_list(F.struct("at", "core"))).alias("c"))
    )
    new = cut(new).select("raw", "n", _format(F.col("raw"), F.col("whole"), F.col("c.core"), key).alias("new"))
    placed = hot_left_join(spots, cut(new), "raw", "n")
    by_text = placed.groupBy("_pii_key").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_pii_new"))
    by_text = cut(by_text.join(texts.select("_pii_key", "n"), "_pii_key"))
    gaps = F.split("text", F.coalesce("_pii_pattern", F.lit(ANY)), -1)
    woven = F.concat(
        F.array_join(F.transform(F.col("_pii_new"), lambda e, i: F.concat(F.element_at(F.col("_pii_gaps"), i + 1), e["new"])), ""),
        F.element_at("_pii_gaps", -1),
    )
    done = hot_left_join(dirty, by_text, "_pii_key", "n").withColumn("_pii_gaps", gaps).withColumn("_pii_n", F.size("_pii_raw").cast("long"))
    return clean.unionByName(done.withColumn("text", woven).select(*names, "_pii_n"))


def scrub(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates; a column n_chars follows the new text."""

    def apply(own: DataFrame) -> DataFrame:
        out = replace(own, key)
        if "n_chars" in own.columns:
            kind = dict(own.dtypes)["n_chars"]
            out = out.withColumn("n_chars", F.when(F.col("_pii_n") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
        return out

    return guarded(docs, {"doc_id", "text", "n_chars"}, apply)
