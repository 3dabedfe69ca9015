"""Identifier formats: validity, normal form and display form as Columns, after the public standards.

Each format is a row of ``FORMATS``. Checksums are folds over digit arrays, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text as T
from lexigrain.kernels.udf import ColumnLike, col

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _upper(c: Column) -> Column:
    return F.upper(T.strip(c))


def _compact(c: Column, drop: str = r"[\s\-]") -> Column:
    return F.upper(F.regexp_replace(T.strip(c), drop, ""))


def _values(c: Column, alphabet: str = ALNUM) -> Column:
    """Positions of a text's characters in an alphabet."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.position(x, F.lit(alphabet)) - 1)


def _weighted(values: Column, weights: list[int]) -> Column:
    """Sum of products with the weights; values beyond them don't count."""
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(F.slice(values, 1, len(weights)), w, lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0), lambda s, x: s + x)


def _mod97(c: Column) -> Column:
    """Remainder of the number that the characters spell with A = 10 to Z = 35."""
    return F.aggregate(_values(c), F.lit(0), lambda s, x: F.when(x > 9, (s * 100 + x) % 97).otherwise((s * 10 + x) % 97))


def _luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def _digits_of(c: Column) -> Column:
    """Letters as two digits, digits as they are."""
    return F.array_join(F.transform(_values(c), lambda x: x.cast("string")), "")


_ISO2 = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET "
    "FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD "
    "ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST "
    "SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW"
).split()
_ISIN_EXTRA = ["EU", "QS", "QT", "QW", "QX", "QY", "QZ", "XA", "XB", "XC", "XD", "XF", "XK", "XS", "AN", "CS"]
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21,
    HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22,
    SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, MN=20, NI=28, RU=33, SO=23, BI=27, DJ=27, FK=18, OM=23, YE=30,
)


def _isin(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.substring(c, 1, 2).isin(*_ISO2, *_ISIN_EXTRA) & _luhn(_digits_of(c))


def _iban(c: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return c.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$") & (F.length(c) == F.element_at(lengths, F.substring(c, 1, 2))) & (_mod97(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))) == 1)


def _figi(c: Column) -> Column:
    body = F.transform(_values(F.substring(c, 1, 11)), lambda x, i: F.when(i % 2 == 1, x * 2).otherwise(x))
    total = F.aggregate(body, F.lit(0), lambda s, x: s + F.floor(x / 10).cast("int") + x % 10)
    shape = c.rlike(r"^[B-DF-HJ-NP-TV-Z]{2}G[B-DF-HJ-NP-TV-Z0-9]{8}\d$")
    return shape & ~F.substring(c, 1, 2).isin("BS", "BM", "GG", "GB", "VG") & ((10 - total % 10) % 10 == F.substring(c, 12, 1).cast("int"))


def _bic(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{6}[0-9A-Z]{2}([0-9A-Z]{3})?$")


def _inn(c: Column) -> Column:
    v = _values(c)
    check = lambda w: _weighted(v, w) % 11 % 10
    ten = (F.length(c) == 10) & (check([2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(v, 9))
    twelve = (F.length(c) == 12) & (check([7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(v, 10)) & (check([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(v, 11))
    return c.rlike(r"^(\d{10}|\d{12})$") & (ten | twelve)


def _lei(c: Column) -> Column:
    return c.rlike(r"^[A-Z0-9]{18}\d{2}$") & (_mod97(c) == 1)


def _ssn(c: Column) -> Column:
    plain = F.regexp_replace(c, "-", "")
    shape = c.rlike(r"^(\d{3}-\d{2}-\d{4}|\d{9})$")
    return shape & ~plain.rlike("^(000|666|9)") & (F.substring(plain, 4, 2) != "00") & (F.substring(plain, 6, 4) != "0000") & ~plain.isin("078051120", "457555462", "219099999")


def _cpf(c: Column) -> Column:
    v = _values(c)
    digit = lambda w: (11 - _weighted(v, w) % 11) % 11 % 10
    return c.rlike(r"^\d{11}$") & ~c.rlike(r"^0+$") & (digit(list(range(10, 1, -1))) == F.get(v, 9)) & (digit(list(range(11, 1, -1))) == F.get(v, 10))


def _cnpj(c: Column) -> Column:
    v = _values(c)
    digit = lambda w: (11 - _weighted(v, w) % 11) % 11 % 10
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return c.rlike(r"^\d{14}$") & ~c.rlike(r"^0+$") & (digit(first) == F.get(v, 12)) & (digit([6, *first]) == F.get(v, 13))


_USCC = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def _uscc(c: Column) -> Column:
    weights, w = [], 1
    for _ in range(17):
        weights.append(w)
        w = w * 3 % 31
    check = (31 - _weighted(_values(c, _USCC), weights) % 31) % 31
    return c.rlike(rf"^\d{{8}}[{_USCC}]{{10}}$") & (F.substring(F.lit(_USCC), 1, 31).substr(check + 1, F.lit(1)) == F.substring(c, 18, 1))


def ogrn_control_digit(c: ColumnLike) -> Column:
    """The control digit of an OGRN of 13 or 15 digits."""
    c = col(c)
    n = F.try_to_number(F.substring(c, 1, 12), F.lit("999999999999")).cast("bigint")
    m = F.try_to_number(F.substring(c, 1, 14), F.lit("99999999999999")).cast("bigint")
    return F.when(F.length(c) == 13, (n % 11 % 10).cast("int")).when(F.length(c) == 15, (m % 13 % 10).cast("int"))


def _ogrn_code(c: Column) -> Column:
    return F.coalesce(T.empty_to_null(F.regexp_extract(c, r"\b([1-9]\d{14}|[1-9]\d{12})\b", 1)), F.lit(None).cast("string"))


def _ogrn(c: Column) -> Column:
    return c.rlike(r"^[1-9](\d{12}|\d{14})$") & (ogrn_control_digit(c) == F.substring(c, -1, 1).cast("int"))


def _npi(c: Column) -> Column:
    ten = F.when(F.length(c) == 15, F.substring(c, 6, 10)).otherwise(c)
    return c.rlike(r"^(\d{10}|80840\d{10})$") & ~c.isin("0000000000", "1111111111", "9999999999") & _luhn(F.concat(F.lit("80840"), ten))


def _uei(c: Column) -> Column:
    return c.rlike(r"^[1-9A-HJ-NP-Z][0-9A-HJ-NP-Z]{11}$")


# IMO numbers: vessels and companies


def _imo_vessel(d: Column) -> Column:
    return (_weighted(_values(d), [7, 6, 5, 4, 3, 2]) % 10) == F.substring(d, 7, 1).cast("int")


def _imo_company(d: Column) -> Column:
    return ((11 - _weighted(_values(d), [8, 6, 4, 2, 9, 7]) % 11) % 10) == F.substring(d, 7, 1).cast("int")


def _imo_candidates(c: Column) -> Column:
    """Digit runs of five to seven, padded, best first: longer, prefixed, earlier."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?:\bIMO[\s:#.\-]*(?:NO\.?|NUMBER)?[\s:#.\-]*)?(?<!\d)\d{5,7}(?!\d)"), 0)
    rows = F.transform(found, lambda x, i: F.struct((-F.length(F.regexp_extract(x, r"(\d+)$", 1))).alias("n"), (~F.upper(x).startswith("IMO")).alias("plain"), i.alias("i"), F.lpad(F.regexp_extract(x, r"(\d+)$", 1), 7, "0").alias("d")))
    return F.filter(F.transform(F.array_sort(rows), lambda r: r["d"]), lambda d: d != "0000000")


def is_valid_vessel(c: ColumnLike) -> Column:
    return F.coalesce(F.exists(_imo_candidates(col(c)), _imo_vessel), F.lit(False))


def is_valid_company(c: ColumnLike) -> Column:
    return F.coalesce(F.exists(_imo_candidates(col(c)), _imo_company), F.lit(False))


def _imo_normal(c: Column) -> Column:
    good = F.filter(_imo_candidates(c), lambda d: _imo_vessel(d) | _imo_company(d))
    return F.concat(F.lit("IMO"), F.get(good, 0))


def _imo_shown(c: Column) -> Column:
    """With its prefix, which a number that can't be one gets, too."""
    c = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(c.startswith("IMO"), c).otherwise(F.concat(F.lit("IMO"), c))


@dataclass(frozen=True)
class Format:
    """A format: ``normal`` gives the normal form of a text or null, ``check`` the validity, ``show`` the display form of a normal form."""

    name: str
    title: str
    strong: bool
    normal: Callable[[Column], Column]
    check: Callable[[Column], Column]
    show: Callable[[Column], Column] = lambda c: c
    names: tuple[str, ...] = ()

    def is_valid(self, c: ColumnLike) -> Column:
        return F.coalesce(self.check(col(c)), F.lit(False))

    def normalize(self, c: ColumnLike) -> Column:
        return self.normal(col(c))

    def format(self, c: ColumnLike) -> Column:
        return self.show(F.coalesce(self.normal(col(c)), _upper(col(c))))


def _checked(compact: Callable[[Column], Column], check: Callable[[Column], Column]) -> dict[str, Callable[[Column], Column]]:
    """A format that is compared in its compact form, and has no normal form unless valid."""

    def normal(c: Column) -> Column:
        x = compact(c)
        return F.when(check(x), x)

    return {"normal": normal, "check": lambda c: check(compact(c))}


def _groups(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def _strict_normal(c: Column) -> Column:
    x = F.upper(F.regexp_replace(T.maybe_ascii(c), r"[^A-Za-z0-9]", ""))
    return F.when(F.length(x) >= 2, x)


def _qid(c: Column) -> Column:
    x = F.upper(T.strip(F.element_at(F.split(F.regexp_replace(T.strip(c), "/+$", ""), "/"), -1)))
    return F.when(x.rlike(r"^Q\d+$"), x)


def is_qid(c: ColumnLike) -> Column:
    return col(c).rlike(r"^Q\d+$")


_word = lambda pattern: lambda c: T.empty_to_null(F.regexp_extract(F.upper(c), rf"(?<![0-9A-Z])({pattern})(?![0-9A-Z])", 1))
_plain_digits = lambda c: F.regexp_replace(T.strip(c), r"[\s.\-/]", "")

FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format("generic", "Generic identifier", False, lambda c: T.empty_to_null(T.strip(c)), lambda c: T.strip(c) != "", names=("null",)),
        Format("strict", "Strict identifier", False, _strict_normal, lambda c: F.length(_strict_normal(c)) > 2),
        Format("wikidata", "Wikidata QID", True, _qid, lambda c: _qid(c).isNotNull(), names=("qid",)),
        Format("ogrn", "Russian main state registration number", True, lambda c: F.when(_ogrn(_ogrn_code(c)), _ogrn_code(c)), lambda c: _ogrn(_ogrn_code(c))),
        Format("imo", "IMO number", True, _imo_normal, lambda c: _imo_normal(c).isNotNull(), show=_imo_shown),
        Format("npi", "National provider identifier", True, lambda c: F.when(_npi(_word(r"\d{10}|80840\d{10}")(c)), _word(r"\d{10}|80840\d{10}")(c)), lambda c: _npi(T.strip(c))),
        Format("uei", "Unique entity identifier", False, lambda c: _word("[1-9A-HJ-NP-Z][0-9A-HJ-NP-Z]{11}")(c), lambda c: _uei(_upper(c))),
        Format("isin", "International securities identification number", True, **_checked(lambda c: _compact(c, r"\s"), _isin)),
        Format("iban", "International bank account number", True, **_checked(lambda c: _compact(c, r"[\s\-.]"), _iban), show=lambda c: F.rtrim(_groups(c, "(.{4})", "$1 "))),
        Format("figi", "Financial instrument global identifier", True, **_checked(lambda c: _compact(c, r"\s"), _figi), names=("openfigi",)),
        Format("bic", "Business identifier code", True, lambda c: F.when(_bic(_compact(c)), F.substring(_compact(c), 1, 8)), lambda c: _bic(_compact(c)), names=("swift",)),
        Format("inn", "Russian tax number", True, **_checked(lambda c: _compact(c, r"\s"), _inn)),
        Format("lei", "Legal entity identifier", True, **_checked(_compact, _lei)),
        Format("ssn", "US social security number", False, lambda c: F.when(_ssn(T.strip(c)), F.regexp_replace(T.strip(c), "-", "")), lambda c: _ssn(T.strip(c)), show=lambda c: _groups(F.regexp_replace(c, "-", ""), r"^(\d{3})(\d{2})(\d{4})$", "$1-$2-$3")),
        Format("cpf", "Brazilian natural person number", False, **_checked(_plain_digits, _cpf), show=lambda c: _groups(_plain_digits(c), r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")),
        Format("cnpj", "Brazilian company number", True, **_checked(_plain_digits, _cnpj), show=lambda c: _groups(_plain_digits(c), r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")),
        Format("uscc", "Chinese unified social credit code", True, **_checked(_compact, _uscc)),
    )
}
_ALIASES = {alias: f for f in FORMATS.values() for alias in f.names}


def get_identifier_format(name: str) -> Format:
    found = FORMATS.get(name) or _ALIASES.get(name)
    if found is None:
        raise KeyError(name)
    return found


def get_identifier_format_names() -> list[str]:
    return [*FORMATS, *_ALIASES]


def get_strong_format_names() -> list[str]:
    return [n for n in get_identifier_format_names() if get_identifier_format(n).strong]


def get_identifier_formats() -> list[dict]:
    return sorted(({"name": f.name, "title": f.title, "names": [f.name, *f.names]} for f in FORMATS.values()), key=lambda x: x["title"])


def formats_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, f.title, f.strong) for f in FORMATS.values()], "name string, title string, strong boolean")
