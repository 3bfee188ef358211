"""Named formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code lists.
CURRENCIES = "AED ARS AUD BDT BGN BHD BRL CAD CHF CLP CNY COP CZK DKK EGP EUR GBP GHS HKD HRK HUF IDR ILS INR ISK JOD JPY KES KRW KWD LBP MAD MXN MYR NGN NOK NZD OMR PEN PHP PKR PLN QAR RON RUB SAR SEK SGD THB TRY TWD TZS UAH UGX USD VND ZAR"
COUNTRIES_2 = "AE AR AT AU BD BE BG BH BR CA CH CL CN CO CY CZ DE DK EG ES FI FR GB GH GR HK HR HU ID IE IL IN IS IT JO JP KE KR KW LB MA MX MY NG NL NO NZ OM PE PH PK PL PT QA RO RU SA SE SG TH TR TW TZ UA UG US VN ZA"
COUNTRIES_3 = "ARE ARG AUS AUT BEL BGD BGR BHR BRA CAN CHE CHL CHN COL CYP CZE DEU DNK EGY ESP FIN FRA GBR GHA GRC HKG HRV HUN IDN IND IRL ISL ISR ITA JOR JPN KEN KOR KWT LBN MAR MEX MYS NGA NLD NOR NZL OMN PAK PER PHL POL PRT QAT ROU RUS SAU SGP SWE THA TUR TWN TZA UGA UKR USA VNM ZAF"
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP"


def _rlike(pattern: str):
    return lambda c: F.rlike(c, F.lit(pattern))


def _hostname(c: Column) -> Column:
    labels = F.split(c, r"\.", -1)
    return (c != "") & (F.length(c) <= 253) & F.forall(labels, lambda x: F.rlike(x, F.lit(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?$")))


def _ipv6(c: Column) -> Column:
    groups = F.filter(F.split(c, ":", -1), lambda x: x != "")
    fit = F.forall(groups, lambda x: F.rlike(x, F.lit("^[0-9a-fA-F]{1,4}$")))
    short = F.size(F.split(c, "::", -1)) == 2
    edges = ~F.rlike(c, F.lit("(^:[^:])|([^:]:$)"))
    return fit & edges & F.when(F.contains(c, F.lit("::")), short & (F.size(groups) <= 7)).otherwise((F.size(groups) == 8) & (F.size(F.split(c, ":", -1)) == 8))


def _card(c: Column) -> Column:
    digits = F.regexp_replace(c, "[ -]", "")
    return F.rlike(digits, F.lit(r"^\d{13,19}$")) & F.call_function("luhn_check", digits)


def _phone(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\+?[0-9 ()-]+$")) & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 7)


FORMATS = {
    "email": _rlike(r"^[^@]+@[^@]*\.[^@]*$"),
    "url": _rlike(r"^https?://"),
    "uri": _rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"),
    "uuid": _rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    "ssn": _rlike(r"^(?!000)(?:\d{9}|\d{3}-\d{2}-\d{4})$"),
    "vin": _rlike(r"^[A-HJ-NPR-Za-hj-npr-z0-9]{17}$"),
    "phone": _phone,
    "zip": _rlike(r"^\d{5}(?:-\d{4})?$"),
    "hostname": _hostname,
    "ipv4": _rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"),
    "ipv6": _ipv6,
    "datetime": _rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    "creditcard": _card,
    "iban": _rlike(r"^[A-Za-z]{2}\d{2}[A-Za-z0-9]{4,30}$"),
    "bic": _rlike(r"^[A-Za-z]{6}[A-Za-z0-9]{2}(?:[A-Za-z0-9]{3})?$"),
    "routing": _rlike(r"^\d{9}$"),
    "cusip": _rlike(r"^[A-Za-z0-9]{9}$"),
    "isin": _rlike(r"^[A-Za-z]{2}[A-Za-z0-9]{9}\d$"),
    "lei": _rlike(r"^[A-Za-z0-9]{20}$"),
    "npi": _rlike(r"^\d{10}$"),
    "dea": _rlike(r"^[A-Za-z]{2}\d{7}$"),
    "imei": _rlike(r"^\d{15}$"),
    "iccid": _rlike(r"^\d{19,20}$"),
    "date-iso": _rlike(r"^\d{4}-\d{2}-\d{2}$"),
    "naic": _rlike(r"^\d{5}$"),
    "fein": _rlike(r"^\d{2}-\d{7}$"),
    "currency-code": lambda c: c.isin(*CURRENCIES.split()),
    "country-alpha2": lambda c: c.isin(*COUNTRIES_2.split()),
    "country-alpha3": lambda c: c.isin(*COUNTRIES_3.split()),
    "state-us": lambda c: c.isin(*STATES.split()),
}
ALIASES = {"date-time": "datetime", "credit-card": "creditcard", "swift": "bic"}


def is_format(c: Column, name: str) -> Column | None:
    """Whether a text has a format; None for an unknown name, which is ignored. Null is null."""
    name = name.lower()
    rule = FORMATS.get(ALIASES.get(name, name))
    return rule(c) if rule else None
