"""The rules: kinds, their aliases, and a definition for each kind and country.

The values (weights, remainder tables, lengths, keys, register codes) are fixed values: they
must equal those of the published rules. Codes of German register courts are over two
thousand and change; they are a parameter (see functions.engine.Registers), not a table here.
"""

from __future__ import annotations

from .model import (
    BASE36,
    DIGITS,
    Branch,
    Canonical,
    Check,
    Checksum,
    Definition,
    Sum,
    Test,
    View,
    at,
    chars,
    check,
    digit,
    length,
    on,
    one,
    plain,
    prefix,
    second_try,
    weighted,
)

RULES_VERSION, FORMAT_VERSION, ENGINE_VERSION = "2026.08.38", 1, "0.1.0"
CAPABILITIES = (1, 2, 3, 4, 5, 10, 11, 20, 21, 30, 31, 32, 33, 34, 35, 40, 41, 42)
PROFILES = ("compatible", "strict_current")
MAX_INPUT_BYTES = 1024
UPPER = BASE36[10:]
NOT_PUBLISHED, NOT_SUPPORTED = "checksum_not_published", "unsupported_checksum"

#: All reason codes of reports and errors; registry_not_configured is for callers that ask a registry. Fixed values.
REASON_CODES = """
ok empty invalid_length invalid_characters invalid_format country_mismatch invalid_checksum invalid_encoding input_too_long
unsupported_kind unsupported_country unsupported_format unsupported_checksum checksum_not_published missing_country_code
not_requested not_run_format_invalid not_run_format_unsupported registry_not_configured invalid_ruleset incompatible_ruleset
""".split()

#: Kinds with their aliases. Fixed values.
KINDS = {
    "cegjegyzekszam": ["hu_cegjegyzekszam"],
    "cnpj": ["br_cnpj"],
    "codice_fiscale_impresa": ["it_codice_fiscale_impresa"],
    "company_number": ["company_registration_number", "crn", "gb_company_number", "uk_company_number"],
    "corporate_number": ["hojin_bango", "houjin_bangou", "jp_corporate_number"],
    "cro_number": ["ie_cro_number"],
    "cui": ["cif", "ro_cui"],
    "cvr": ["cvr_nummer", "dk_cvr"],
    "duns": ["dnb", "duns_number"],
    "eik": ["bg_eik", "bulstat"],
    "ein": ["federal_tax_id", "us_ein"],
    "enterprise_number": ["be_enterprise_number", "numero_entreprise", "ondernemingsnummer"],
    "eori": ["eori_number"],
    "euid": [],
    "firmenbuchnummer": ["at_firmenbuchnummer", "fn"],
    "gemi": ["el_gemi", "gr_gemi"],
    "handelsregisternummer": ["de_handelsregisternummer", "hrb"],
    "he_number": ["cy_he_number"],
    "ico": ["cz_ico", "sk_ico"],
    "juridinio_asmens_kodas": ["lt_juridinio_asmens_kodas"],
    "krs": ["pl_krs"],
    "kvk": ["kvk_nummer", "nl_kvk"],
    "lei": [],
    "maticna_stevilka": ["si_maticna_stevilka"],
    "mbr_number": ["mt_mbr_number"],
    "mbs": ["hr_mbs"],
    "nif": ["es_nif"],
    "nipc": ["pt_nipc"],
    "organisationsnummer": ["se_organisationsnummer"],
    "rcs_number": ["lu_rcs_number"],
    "registracijas_numurs": ["lv_registracijas_numurs"],
    "registrikood": ["ee_registrikood"],
    "siren": ["fr_siren"],
    "siret": ["fr_siret"],
    "uscc": ["cn_uscc", "unified_social_credit_code", "usci"],
    "vat": ["vat_id", "vat_number"],
    "y_tunnus": ["business_id", "fi_y_tunnus"],
}

#: Country tokens that stand for another, by kind. Fixed values.
COUNTRY_ALIASES = {"vat": {"EL": "GR", "UK": "GB"}}

#: Codes of French commercial court registers. Fixed values.
FRENCH_REGISTERS = """
0101 0202 0203 0301 0303 0401 0501 0601 0602 0603 0605 0702 0802 0901 1001 1101 1104 1203 1301 1303 1304 1305 1402
1407 1501 1601 1704 1708 1801 1901 2001 2002 2104 2202 2301 2401 2402 2501 2602 2701 2702 2801 2901 2903 3003 3102
3201 3302 3303 3402 3405 3501 3502 3601 3701 3801 3802 3902 4001 4002 4101 4201 4202 4302 4401 4402 4502 4601 4701
4801 4901 5001 5002 5101 5103 5201 5301 5401 5402 5501 5601 5602 5751 5752 5753 5802 5902 5906 5910 5952 6001 6002
6101 6201 6202 6303 6401 6403 6502 6601 6751 6752 6851 6852 6901 6903 7001 7102 7106 7202 7301 7401 7402 7501 7601
7606 7608 7701 7702 7801 7802 7803 7901 8002 8101 8102 8201 8302 8303 8305 8401 8501 8602 8701 8801 8901 8903 9001
9201 9301 9401 9711 9712 9721 9731 9741 9742 9761
""".split()

#: Prefixes of British company numbers. Fixed values.
BRITISH_PREFIXES = """
AC CE CS EN ES FC FE GE GN GS IC IP LP NA NC NF NI NL NO NP NR NV NZ OC OE PC R0 RC RS SA SC SE SF SG SI SL SO SP SR SZ ZC
""".split()

# Remainder tables (modulus 11 or 10). Fixed values.
TEN_IS_0 = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0)
TEN_IS_10 = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
LOW_IS_0 = (0, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1)
FROM_11 = (0, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1)
CZECH = (1, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1)
LATVIAN = (3, 2, 1, 0, 10, 9, 8, 7, 6, 5, 4)
FROM_10 = (0, 9, 8, 7, 6, 5, 4, 3, 2, 1)

CNPJ = "0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ"
USCC = "0123456789ABCDEFGHJKLMNPQRTUWXY"
SPANISH_ENTITY, SPANISH_CONTROL = "ABCDEFGHJNPQRSUVW", "ABCDEFGHJKLMNPQRSTVWXYZ"
ROMANIAN = (70, 50, 30, 20, 10, 70, 50, 30, 20)


def _luhn(start: int = 0, end: int | None = None, key: str | None = None) -> Sum:
    return Sum("luhn", View(start, end), key=key)


def _none(reason: str = NOT_PUBLISHED) -> Sum:
    return Sum("unsupported", reason=reason)


def _two_pass(first: tuple[int, ...], second: tuple[int, ...], n: int) -> tuple[Branch, ...]:
    a, b = weighted(first, 11, View(0, n)), weighted(second, 11, View(0, n))
    return second_try(a, digit(b, n, TEN_IS_0), digit(a, n, TEN_IS_0))


def _belgian(at_: int = 0) -> Checksum:
    return on(View(at_), one(Sum("number", View(0, 8), modulus=97, complement=True, against="digits", digits=View(8, 10))))


def _romanian() -> Checksum:
    return one(digit(weighted(ROMANIAN, 11, View(0, -1), alignment="right"), -1, TEN_IS_0))


def _lithuanian() -> Checksum:
    first, second = weighted((1, 2, 3, 4, 5, 6, 7, 8, 9), 11, View(0, 9)), weighted((3, 4, 5, 6, 7, 8, 9, 1, 2), 11, View(0, 9), table=TEN_IS_0)
    return (second_try(first, second, first),)


_PLAIN, _DOTS = Canonical(remove="-./"), Canonical(remove="-.")
_SIREN_SUM = _luhn(0, 9)

#: kind, country: canonicalization, checks, checksum. The national rules.
NATIONAL: dict[tuple[str, str], tuple[Canonical, tuple[Check, ...], Checksum | str]] = {
    ("cegjegyzekszam", "HU"): (Canonical(remove="-/"), plain("hu.cegjegyzekszam", 10), NOT_PUBLISHED),
    ("cnpj", "BR"): (
        _PLAIN,
        plain("cnpj", 14, BASE36, check("invalid_characters", "cnpj.check_digits", chars(DIGITS, View(12, 14)))),
        (
            (Branch((digit(weighted((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), 11, View(0, 12), alphabet=CNPJ), 12, LOW_IS_0),)),),
            (Branch((digit(weighted((6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), 11, View(0, 13), alphabet=CNPJ), 13, LOW_IS_0),)),),
        ),
    ),
    ("codice_fiscale_impresa", "IT"): (_PLAIN, plain("it.codice_fiscale_impresa", 11), one(_luhn())),
    ("company_number", "GB"): (_DOTS, plain("company_number", 8, BASE36, check("invalid_format", "company_number.prefix", chars(), Test("listed", View(0, 2), "british"))), NOT_PUBLISHED),
    ("corporate_number", "JP"): (Canonical(upper=False, remove="-."), plain("corporate_number", 13), one(weighted((1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1), 9, View(0, 13)))),
    ("cro_number", "IE"): (_PLAIN, plain("ie.cro_number", [(5, 7)]), NOT_PUBLISHED),
    ("cui", "RO"): (_PLAIN, plain("ro.cui", [(2, 10)]), _romanian()),
    ("cvr", "DK"): (_PLAIN, plain("dk.cvr", 8, DIGITS, check("invalid_format", "dk.cvr.leading", ~prefix("0"))), one(weighted((2, 7, 6, 5, 4, 3, 2, 1), 11, View(0, 8)))),
    ("duns", "GLOBAL"): (Canonical(upper=False, remove="-."), plain("duns", 9), NOT_PUBLISHED),
    ("eik", "BG"): (_PLAIN, plain("bg.eik", [(9, 9), (13, 13)]), (_two_pass((1, 2, 3, 4, 5, 6, 7, 8), (3, 4, 5, 6, 7, 8, 9, 10), 8),)),
    ("ein", "US"): (Canonical(upper=False, remove="-"), plain("ein", 9), NOT_PUBLISHED),
    ("enterprise_number", "BE"): (Canonical(upper=False, remove="-./"), plain("be.enterprise_number", 10, DIGITS, check("invalid_format", "be.enterprise_number.leading", at(0, "01"))), _belgian()),
    ("eori", "GLOBAL"): (Canonical(), plain("eori", [(3, 17)], BASE36, check("invalid_format", "eori.country_prefix", chars(UPPER, View(0, 2)))), NOT_PUBLISHED),
    ("firmenbuchnummer", "AT"): (
        Canonical(remove=" -./"),
        plain("at.firmenbuchnummer", [(2, 7)], BASE36, check("invalid_format", "at.firmenbuchnummer.shape", *[(length(n), chars(DIGITS, View(0, n - 1)), at(n - 1, UPPER)) for n in range(2, 8)])),
        NOT_PUBLISHED,
    ),
    ("gemi", "EL"): (_PLAIN, plain("el.gemi", 12), NOT_PUBLISHED),
    ("handelsregisternummer", "DE"): (_PLAIN, plain("de.handelsregisternummer", [(1, 20)], BASE36), NOT_PUBLISHED),
    ("he_number", "CY"): (Canonical(remove=" -./"), plain("cy.he_number", 6), NOT_PUBLISHED),
    ("ico", "CZ"): (_PLAIN, plain("cz.ico", 8), one(digit(weighted((8, 7, 6, 5, 4, 3, 2), 11, View(0, 7)), 7, CZECH))),
    ("ico", "SK"): (_PLAIN, plain("sk.ico", 8), one(digit(weighted((8, 7, 6, 5, 4, 3, 2), 11, View(0, 7)), 7, CZECH))),
    ("juridinio_asmens_kodas", "LT"): (_PLAIN, plain("lt.juridinio_asmens_kodas", 9), _lithuanian()),
    ("krs", "PL"): (_PLAIN, plain("pl.krs", 10), NOT_PUBLISHED),
    ("kvk", "NL"): (_PLAIN, plain("nl.kvk", 8), NOT_PUBLISHED),
    ("lei", "GLOBAL"): (Canonical(remove="-"), plain("lei", 20, BASE36, check("invalid_characters", "lei.check_digits", chars(DIGITS, View(18, 20)))), one(Sum("mod97"))),
    ("maticna_stevilka", "SI"): (_PLAIN, plain("si.maticna_stevilka", 7), NOT_PUBLISHED),
    ("mbr_number", "MT"): (
        _PLAIN,
        (*plain("mt.mbr_number", [(5, 7)])[:2], check("invalid_format", "mt.mbr_number.prefix", prefix("C")), check("invalid_characters", "mt.mbr_number.characters", chars(DIGITS, View(1)))),
        NOT_PUBLISHED,
    ),
    ("mbs", "HR"): (_PLAIN, plain("hr.mbs", 8), NOT_PUBLISHED),
    ("nif", "ES"): (
        _PLAIN,
        plain("es.nif", 9, BASE36, check("invalid_format", "es.nif.legal_entity", at(0, SPANISH_ENTITY)), check("invalid_characters", "es.nif.body", chars(DIGITS, View(1, 8)))),
        ((Branch((_luhn(1, 9),), tests=(at(8, DIGITS),)), Branch((_none(),))),),
    ),
    ("nipc", "PT"): (_PLAIN, plain("pt.nipc", 9), one(digit(weighted((9, 8, 7, 6, 5, 4, 3, 2), 11, View(0, 8)), 8, LOW_IS_0))),
    ("organisationsnummer", "SE"): (_PLAIN, plain("se.organisationsnummer", 10, DIGITS, check("invalid_format", "se.organisationsnummer.group", at(2, "23456789"))), one(_luhn())),
    ("rcs_number", "LU"): (
        _PLAIN,
        (*plain("lu.rcs_number", [(5, 7)])[:2], check("invalid_format", "lu.rcs_number.prefix", at(0, UPPER)), check("invalid_characters", "lu.rcs_number.characters", chars(DIGITS, View(1)))),
        NOT_PUBLISHED,
    ),
    ("registracijas_numurs", "LV"): (
        _PLAIN,
        plain("lv.registracijas_numurs", 11, DIGITS, check("invalid_format", "lv.registracijas_numurs.legal_entity", at(0, "456789"))),
        one(digit(weighted((9, 1, 4, 8, 3, 10, 2, 5, 7, 6), 11, View(0, 10)), 10, LATVIAN)),
    ),
    ("registrikood", "EE"): (_PLAIN, plain("ee.registrikood", 8), (_two_pass((1, 2, 3, 4, 5, 6, 7), (3, 4, 5, 6, 7, 8, 9), 7),)),
    ("siren", "FR"): (_PLAIN, plain("fr.siren", 9), one(_luhn())),
    ("siret", "FR"): (
        _PLAIN,
        plain("fr.siret", 14),
        ((Branch((_SIREN_SUM,)),), (Branch((_luhn(), Sum("weighted", View(0, 14), (1,), "cycle", modulus=5)), tests=(prefix("356000000"),)), Branch((_luhn(key="fr.siret.luhn"),)))),
    ),
    ("uscc", "CN"): (
        _DOTS,
        plain("uscc", 18, USCC),
        one(weighted((1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28, 1), 31, alphabet=USCC)),
    ),
    ("y_tunnus", "FI"): (Canonical(remove="./"), plain("fi.y_tunnus", 8), one(digit(weighted((7, 9, 10, 5, 8, 4, 2), 11, View(0, 7)), 7, FROM_11))),
}

#: Countries of the EUID and the kind of their national part. Fixed values.
EUID_NATIONAL = {
    "AT": "firmenbuchnummer",
    "BE": "enterprise_number",
    "BG": "eik",
    "CY": "he_number",
    "CZ": "ico",
    "DE": "handelsregisternummer",
    "DK": "cvr",
    "EE": "registrikood",
    "EL": "gemi",
    "ES": "nif",
    "FI": "y_tunnus",
    "FR": "siren",
    "HR": "mbs",
    "HU": "cegjegyzekszam",
    "IE": "cro_number",
    "IT": "codice_fiscale_impresa",
    "LT": "juridinio_asmens_kodas",
    "LU": "rcs_number",
    "LV": "registracijas_numurs",
    "MT": "mbr_number",
    "NL": "kvk",
    "PL": "krs",
    "PT": "nipc",
    "RO": "cui",
    "SE": "organisationsnummer",
    "SI": "maticna_stevilka",
    "SK": "ico",
}
#: Registers of a EUID: length, characters, and the list they must be on; else 1 to 8 alphanumerics.
EUID_REGISTERS = {"DE": ((5, 6), BASE36, "german"), "FR": ((4, 4), DIGITS, "french")}


def _euid(country: str) -> Definition:
    _, checks, checksum = NATIONAL[EUID_NATIONAL[country], country]
    key, register, tail = f"euid.{country.lower()}", View(base="register"), View(base="tail")
    (least, most), alphabet, listed = EUID_REGISTERS.get(country, ((1, 8), BASE36, None))
    own = [
        check("empty", f"{key}.empty", Test("empty", negated=True)),
        check("invalid_format", f"{key}.prefix", prefix(country)),
        check("invalid_format", f"{key}.separator", Test("contains", text=".")),
        check("invalid_format", f"{key}.register", Test("absent", register, negated=True)),
        check("invalid_length", f"{key}.register_length", length(least, most, register)),
        check("invalid_characters", f"{key}.register_characters", chars(alphabet, register)),
    ]
    if listed:
        own.append(check("invalid_format", f"{key}.register_unknown", Test("listed", register, listed)))
    return Definition("euid", country, Canonical(remove="-" if country == "HU" else "", prepend_country=True), (*own, *[c.on(tail) for c in checks]), checksum if isinstance(checksum, str) else on(tail, checksum), (country,), country)


def _vat(country: str, lengths, *more: Check, checksum: Checksum | str, body: bool = True, prefixes: tuple[str, ...] = (), canonical: Canonical = Canonical(remove="-./", prepend_country=True)) -> Definition:
    key, own = f"vat.{country.lower()}", (prefixes or (country,))[0]
    base = plain(key, lengths)[:2]
    characters = (check("invalid_characters", f"{key}.characters", chars(DIGITS, View(2))),) if body else ()
    return Definition("vat", country, canonical, (*base, check("invalid_format", f"{key}.prefix", prefix(own)), *characters, *more), checksum, prefixes or (country,), own)


def _after(checksum: Checksum, start: int = 2) -> Checksum:
    return on(View(start), checksum)


def _british() -> Checksum:
    sums = tuple(weighted((8, 7, 6, 5, 4, 3, 2, 10, 1), 97, View(2, 11), constant=c) for c in (0, 42))
    return ((Branch(sums),),)


def _guarded(test: Test, *branches: Branch) -> Checksum:
    """No published checksum where the test fails."""
    return ((Branch((_none(),), tests=(~test,)), *branches),)


_VAT = [
    _vat("AT", 11, check("invalid_characters", "vat.at.characters", chars(DIGITS, View(3))), check("invalid_format", "vat.at.u_marker", at(2, "U")), checksum=NOT_SUPPORTED, body=False),
    _vat("BE", 12, check("invalid_format", "vat.be.enterprise_prefix", at(2, "01")), checksum=_belgian(2), canonical=Canonical(remove="-./", prepend_country=True, insert_when=(11, 2, "0"))),
    _vat("BG", [(11, 11), (12, 12)], checksum=_guarded(length(11), *[b.on(View(2)) for b in _two_pass((1, 2, 3, 4, 5, 6, 7, 8), (3, 4, 5, 6, 7, 8, 9, 10), 8)])),
    _vat("CY", 11, check("invalid_format", "vat.cy.check_letter", at(10, UPPER)), check("invalid_characters", "vat.cy.body_characters", chars(DIGITS, View(2, 10))), checksum=NOT_SUPPORTED, body=False),
    _vat("CZ", [(10, 12)], checksum=_guarded(length(10), Branch((digit(weighted((8, 7, 6, 5, 4, 3, 2), 11, View(0, 7)), 7, CZECH),)).on(View(2)))),
    _vat("DE", 11, checksum=NOT_SUPPORTED),
    _vat("DK", 10, checksum=_after(one(weighted((2, 7, 6, 5, 4, 3, 2, 1), 11, View(0, 8))))),
    _vat("EE", 11, checksum=_after(one(digit(weighted((3, 7, 1, 3, 7, 1, 3, 7), 10, View(0, 8)), 8, FROM_10)))),
    _vat(
        "ES",
        11,
        check("invalid_characters", "vat.es.characters", chars(BASE36, View(2))),
        check(
            "invalid_format",
            "vat.es.shape",
            (at(2, SPANISH_ENTITY), chars(DIGITS, View(3, 10))),
            (chars(DIGITS, View(2, 10)), at(10, SPANISH_CONTROL)),
            (at(2, "XYZ"), chars(DIGITS, View(3, 10)), at(10, SPANISH_CONTROL)),
        ),
        checksum=((Branch((_luhn(3, 11),), tests=(at(2, SPANISH_ENTITY), at(10, DIGITS))), Branch((_none(),))),),
        body=False,
    ),
    _vat("FI", 10, checksum=_after(one(digit(weighted((7, 9, 10, 5, 8, 4, 2), 11, View(0, 7)), 7, FROM_11)))),
    _vat(
        "FR",
        13,
        check("invalid_characters", "vat.fr.key_characters", chars(DIGITS, View(2, 4)), (Test("profile", text="compatible"), chars(BASE36, View(2, 4)))),
        check("invalid_characters", "vat.fr.siren_characters", chars(DIGITS, View(4))),
        *[c.on(View(4)) for c in NATIONAL["siren", "FR"][1]],
        checksum=(
            *_after(NATIONAL["siren", "FR"][2], 4),
            # the key of a SIREN is (12 + 3 r) modulo 97, where r is its remainder modulo 97
            (Branch((Sum("number", View(4), modulus=97, table=tuple((12 + 3 * r) % 97 for r in range(97)), against="digits", digits=View(2, 4)),), tests=(chars(DIGITS, View(2, 4)),)), Branch((_none(),))),
        ),
        body=False,
    ),
    _vat("GB", [(11, 11), (14, 14)], checksum=_british()),
    _vat("GR", 11, checksum=one(digit(weighted((256, 128, 64, 32, 16, 8, 4, 2), 11, View(2, 10)), 10, TEN_IS_0)), prefixes=("EL", "GR"), canonical=Canonical(remove="-./", replace=("GR", "EL"), prepend_country=True)),
    _vat("HR", 13, checksum=NOT_SUPPORTED),
    _vat("HU", 10, checksum=_after(one(digit(weighted((9, 7, 3, 1, 9, 7, 3), 10, View(0, 7)), 7, FROM_10)))),
    _vat(
        "IE",
        [(10, 11)],
        check("invalid_characters", "vat.ie.characters", chars(BASE36, View(2))),
        check(
            "invalid_format",
            "vat.ie.shape",
            (length(10), chars(DIGITS, View(2, 9)), at(9, UPPER)),
            (length(11), chars(DIGITS, View(2, 9)), at(9, UPPER), at(10, UPPER)),
            (length(10), chars(DIGITS, View(2, 3)), at(3, UPPER), chars(DIGITS, View(4, 9)), at(9, UPPER)),
        ),
        checksum=NOT_SUPPORTED,
        body=False,
    ),
    _vat("IS", [(7, 7), (8, 8), (12, 12)], checksum=_guarded(length(12), Branch((digit(weighted((3, 2, 7, 6, 5, 4, 3, 2), 11, View(0, 8)), 8, FROM_11),)).on(View(2)))),
    _vat("IT", 13, checksum=_after(one(_luhn()))),
    _vat("LI", 7, checksum=NOT_PUBLISHED),
    _vat("LU", 10, checksum=_after(one(Sum("number", View(0, 6), modulus=89, against="digits", digits=View(6, 8))))),
    _vat("LV", 13, checksum=_guarded(at(2, "456789"), Branch((digit(weighted((9, 1, 4, 8, 3, 10, 2, 5, 7, 6), 11, View(0, 10)), 10, LATVIAN),)).on(View(2)))),
    _vat("MT", 10, checksum=_after(one(weighted((3, 4, 6, 7, 8, 9), 37, View(0, 6), complement=True, against="digits", digits=View(6, 8))))),
    _vat(
        "NL",
        14,
        check("invalid_characters", "vat.nl.characters", chars(DIGITS, View(12))),
        check("invalid_format", "vat.nl.b_marker", at(11, "B")),
        check("invalid_characters", "vat.nl.body_characters", chars(DIGITS, View(2, 11))),
        check("invalid_characters", "vat.nl.sub_characters", chars(DIGITS, View(12, 14))),
        checksum=_after(one(digit(weighted((9, 8, 7, 6, 5, 4, 3, 2), 11, View(0, 8)), 8, TEN_IS_10))),
        body=False,
    ),
    _vat("NO", 11, checksum=_after(one(digit(weighted((3, 2, 7, 6, 5, 4, 3, 2), 11, View(0, 8)), 8, FROM_11)))),
    _vat("PL", 12, checksum=_after(one(digit(weighted((6, 5, 7, 2, 3, 4, 5, 6, 7), 11, View(0, 9)), 9, TEN_IS_10)))),
    _vat("PT", 11, checksum=_after(one(digit(weighted((9, 8, 7, 6, 5, 4, 3, 2), 11, View(0, 8)), 8, LOW_IS_0)))),
    _vat("RO", [(4, 12)], checksum=_after(_romanian())),
    _vat("SE", 14, check("invalid_format", "vat.se.branch", ~at(12, "0"), ~at(13, "0")), checksum=_after(one(_luhn(0, 10)))),
    _vat("SI", 10, checksum=_after(one(digit(weighted((8, 7, 6, 5, 4, 3, 2), 11, View(0, 7)), 7, FROM_11)))),
    _vat("SK", 12, checksum=_after(one(Sum("number", View(0, 10), modulus=11)))),
    _vat("XI", [(11, 11), (14, 14)], checksum=_british()),
]


def definitions() -> list[Definition]:
    """All of them, by kind and country."""
    national = [Definition(kind, country, canonical, checks, checksum, (), "" if country == "GLOBAL" else country) for (kind, country), (canonical, checks, checksum) in NATIONAL.items()]
    return sorted([*national, *[_euid(c) for c in EUID_NATIONAL], *_VAT], key=lambda d: (d.kind, d.country))
