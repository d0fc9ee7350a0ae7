"""Personal data by proposal, checksum and context (DataFrame functions only).

Every kind has a pattern that proposes spans, a validator that confirms them
and words nearby that raise the score. The four base kinds are reported whenever
their validator agrees; the further kinds only from a score of `REPORTED` on.

Patterns hold no repeated groups of unbounded length and no unanchored restarts
inside a run, so that a long text costs linear time and no deep recursion.
Where the definition repeats a group, inner separators are first rewritten one
for one to a mark that the text cannot hold, which keeps every position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
NO_MARK = "\x02"
SPANS = "array<struct<start:int,end:int,hit:string>>"
#: Code points before a span in which context words count.
CONTEXT = 48
#: Score from which a span of a further kind is reported.
REPORTED = 0.6

#: Bits a character from which a mixed run counts as random.
TOKEN_BITS = 4.0
# Check letters and the openings of published key formats.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
KEY_FORMATS = "|".join((
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9_-]{20}",
    r"xox[abprs]-[A-Za-z0-9-]{10,72}+",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,99}+",
    r"AIza[A-Za-z0-9_-]{35}",
))
#: Kinds that give access rather than name a person.
SECRETS = ("secret", "access_key", "signed_token", "private_key", "random_token")

_LOCAL = "[A-Za-z0-9._%+\x01-]"
_LABEL = "[A-Za-z0-9-]"


def _marked(text: Column, separator: str) -> Column:
    """`text` with each match of `separator` (one ASCII character) turned into MARK."""
    clean = F.translate(text, MARK, NO_MARK)
    return F.regexp_replace(clean, separator, MARK)


def _is_ip(hit: Column) -> Column:
    return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")


def _is_card(hit: Column) -> Column:
    digits = F.translate(hit, MARK, "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _is_phone(hit: Column) -> Column:
    return F.length(F.translate(hit, "+ ().-", "")).between(9, 15)


def _is_iban(hit: Column) -> Column:
    """Mod-97: the first four characters move to the end, letters count 10 to 35."""
    code = F.translate(hit, " ", "")
    turned = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        turned,
        F.lit(0),
        lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97,
    )
    return F.length(code).between(15, 34) & (rest == 1)


def _is_nir(hit: Column) -> Column:
    """Mod-97 over thirteen digits; the two Corsican departments count as 19 and 18."""
    code = F.translate(hit, " ", "")
    code = F.replace(F.replace(code, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    body, key = F.substring(code, 1, 13).try_cast("long"), F.substring(code, 14, 2).try_cast("long")
    return (F.length(code) == 15) & F.coalesce(97 - body % 97 == key, F.lit(False))


def _is_dni(hit: Column) -> Column:
    """The letter told by the number modulo 23; X, Y, Z before it count 0, 1, 2."""
    number = F.translate(F.substring(hit, 1, 8), "XYZ", "012").try_cast("long")
    letter = F.substring(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))
    return F.coalesce(letter == F.substring(hit, 9, 1), F.lit(False))


def _is_tax_id(hit: Column) -> Column:
    """ISO 7064 mod 11,10; of the first ten digits one occurs twice or three times."""
    digits = F.transform(F.split(F.translate(hit, " ", ""), ""), lambda c: F.ascii(c) - 48)
    first = F.slice(digits, 1, 10)

    def step(acc: Column, d: Column) -> Column:
        s = (d + acc) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    rest = F.aggregate(first, F.lit(10), step)
    return F.size(F.array_distinct(first)).isin(8, 9) & ((11 - rest) % 10 == F.element_at(digits, 11))


def _entropy(hit: Column) -> Column:
    """Bits a character, from the counts of each distinct character."""
    share = lambda c: (F.length(hit) - F.length(F.replace(hit, c, F.lit("")))) / F.length(hit)
    return F.aggregate(
        F.array_distinct(F.split(hit, "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))
    )


def _is_random(hit: Column) -> Column:
    """Digits and letters of both cases, as evenly used as chance would."""
    mixed = hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    return mixed & ~hit.rlike(f"^(?:{KEY_FORMATS})") & (_entropy(hit) >= TOKEN_BITS)


@dataclass(frozen=True)
class Kind:
    name: str
    needs: str  # a cheap test that texts without a span mostly fail
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    mark: str = ""  # separators to mark before the search
    base: bool = False


SECRET_WORDS = (
    r"token|secret|secreto|passw|api[_ -]?key|credential|bearer|\bauth\b|authori[sz]ation"
    r"|mot de passe|jeton|identifiants|contraseña|clave|credencial|passwort|kennwort|geheim|schlüssel|zugang"
)

KINDS = (
    Kind(
        "email",
        "@",
        # \G: right behind an earlier address the rest of the run may start another one.
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?={_LABEL}++\x01)[A-Za-z0-9\x01-]++",
        lambda h: F.lit(True),
        0.9,
        r"mail|contact|write|reach|correo|courriel|kontakt|schreib|escrib|écri",
        mark=rf"(?<={_LABEL})\.(?={_LABEL})",
        base=True,
    ),
    Kind(
        "ip",
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _is_ip,
        0.7,
        r"\bip\b|address|host|server|login|adresse|direcci[oó]n|serveur|servidor|rechner",
        base=True,
    ),
    Kind(
        "card",
        r"(?:[0-9][ -]?){12}[0-9]",
        r"[0-9\x01]{13,}+",
        _is_card,
        0.8,
        r"card|visa|master|credit|debit|pay|carte|cr[eé]dit|tarjeta|pago|karte|zahl",
        mark=r"(?<=[0-9])[ -](?=[0-9])",
        base=True,
    ),
    Kind(
        "phone",
        r"\+[0-9]",
        r"\+[0-9][ ().0-9-]+[0-9]",
        _is_phone,
        0.7,
        r"phone|tel|call|fax|mobil|cell|appel|portable|llam|m[oó]vil|anruf|handy",
        base=True,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        _is_iban,
        0.9,
        r"iban|account|ban[kcq]|transfer|konto|compte|virement|cuenta|ueberweis|überweis",
    ),
    Kind(
        "national_id",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda h: ~h.rlike(r"^(?:000|666|9)|-00-|0000$"),
        0.4,
        r"ssn|social security|national id|tax id|identity",
    ),
    Kind(
        "secret",
        r"[0-9a-f]{32}",
        r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])",
        lambda h: h.rlike("[0-9]") & h.rlike("[a-f]"),
        0.4,
        SECRET_WORDS,
    ),
    Kind(
        "nir",
        r"[12] ?[0-9]{2} ?[01][0-9]",
        r"(?<![0-9A-Za-z])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9A-Za-z])",
        _is_nir,
        0.6,
        r"s[eé]curit[eé] sociale|num[eé]ro de s[eé]cu|\bnir\b|insee|assur[eé]",
    ),
    Kind(
        "dni",
        r"[0-9]{7}[A-Z]",
        r"(?<![0-9A-Za-z])(?:[0-9]{8}|[XYZ][0-9]{7})[A-Z](?![0-9A-Za-z])",
        _is_dni,
        0.5,
        r"\bdni\b|\bnie\b|\bnif\b|identidad|documento",
    ),
    Kind(
        "tax_id",
        r"[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}",
        r"(?<![0-9])[1-9][0-9](?: ?[0-9]{3}){3}(?![0-9])",
        _is_tax_id,
        0.4,
        r"steuer|idnr|\btin\b|tax id|finanzamt",
    ),
    Kind(
        "access_key",
        r"AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|AIza",
        rf"(?<![A-Za-z0-9_-])(?:{KEY_FORMATS})(?![A-Za-z0-9_-])",
        lambda h: F.lit(True),
        0.9,
        SECRET_WORDS,
    ),
    Kind(
        "signed_token",
        r"eyJ[A-Za-z0-9_-]{8}",
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
        lambda h: F.lit(True),
        0.9,
        SECRET_WORDS,
    ),
    Kind(
        "private_key",
        r"-----BEGIN ",
        r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----",
        lambda h: F.lit(True),
        0.95,
        SECRET_WORDS,
    ),
    Kind(
        "random_token",
        r"[A-Za-z0-9+/_-]{24}",
        r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{24,128}+={0,2}+(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9])",
        _is_random,
        0.4,
        SECRET_WORDS,
    ),
)


def find(text: Column, pattern: str) -> Column:
    """All matches with their positions in code points, end exclusive.

    The pieces between the matches and the matches themselves, laid end to end,
    are the text; their lengths give the positions.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), hit.alias("hit")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc.getField("at") + p.getField("gap")
        end = begin + F.coalesce(p.getField("n"), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), p.getField("hit").alias("hit"))
        out = acc.getField("out")
        return F.struct(
            end.alias("at"),
            F.when(p.getField("hit").isNotNull(), F.concat(out, F.array(span))).otherwise(out).alias("out"),
        )

    return F.aggregate(pairs, start, step, lambda acc: acc.getField("out"))


def _spans(text: Column, kind: Kind) -> Column:
    searched = _marked(text, kind.mark) if kind.mark else text
    found = F.filter(find(searched, kind.pattern), lambda s: kind.valid(s.getField("hit")))
    near = lambda s: F.lower(
        F.substring(text, F.greatest(F.lit(1), s.getField("start") + 1 - CONTEXT), F.least(F.lit(CONTEXT), s.getField("start")))
    )
    scored = F.transform(
        found,
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"),
            s.getField("start").alias("start"),
            s.getField("end").alias("end"),
            F.round(F.lit(kind.score) + F.when(near(s).rlike(kind.words), (1 - kind.score) / 2).otherwise(0.0), 3).alias("score"),
        ),
    )
    if not kind.base:
        scored = F.filter(scored, lambda s: s.getField("score") >= REPORTED)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    has = text.contains(kind.needs) if kind.needs == "@" else text.rlike(kind.needs)
    return F.when(has, scored).otherwise(none)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, the number of spans of each base kind, and `found`: kind,
    start, end (code points, end exclusive) and score of every reported span, by
    kind in the order of `KINDS`, then by start.

    Null and empty texts: no spans. Null doc_id: kept as null. Repeated rows:
    one result each. Empty table: empty result. Further columns are ignored.
    Equal spans of two kinds are both reported. Very long texts are searched
    whole, in linear time. Context words are those of the kind's own country and
    of English, French, Spanish and German where the kind has no country.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *[_spans(text, k).alias(k.name) for k in KINDS])
    return rows.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.concat(*[F.col(k.name) for k in KINDS]).alias("found"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts, checksum of the base spans, all spans as text; then
    the number of all spans and of those that give access (`SECRETS`)."""
    written = lambda spans: F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))
        ),
        ",",
    )
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *[f"n_{name}" for name in base],
        F.sha2(written(F.filter("found", lambda s: s.getField("kind").isin(base))), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        F.size(F.filter("found", lambda s: s.getField("kind").isin(*SECRETS))).cast("long").alias("n_secret"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every reported span replaced by its kind in brackets."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("*", F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in KINDS]), _by_start).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at, out = acc.getField("at"), acc.getField("out")
        gap = F.substring(F.col("text"), at + 1, F.greatest(F.lit(0), s.getField("start") - at))
        kept = F.concat(out, gap, F.lit("["), s.getField("kind"), F.lit("]"))
        inside = s.getField("end") <= at
        return F.struct(
            F.greatest(at, s.getField("end")).alias("at"), F.when(inside, out).otherwise(kept).alias("out")
        )

    text = F.aggregate(
        "found", start, step, lambda acc: F.concat(acc.getField("out"), F.substring(F.col("text"), acc.getField("at") + 1, F.length("text")))
    )
    return rows.select("doc_id", text.alias("text"))


def _by_start(a: Column, b: Column) -> Column:
    order = lambda f, up: F.when(a.getField(f) < b.getField(f), -up).when(a.getField(f) > b.getField(f), up)
    return F.coalesce(order("start", 1), order("end", -1), F.lit(0))
