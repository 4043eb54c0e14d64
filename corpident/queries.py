"""Queries over the driver's tables, and their equivalents in SQL.

No table holds identifiers, so they are made from keys by arithmetic that both engines share.
The SQL states each rule on its own terms and shares nothing with the catalog.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpident import functions as api
from corpident.operators import assertions, canonical, integers, outcomes, predicates, strings

Query = Callable[[SparkSession, str], DataFrame]

_LETTERS = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_B36 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
#: table, key of what identifiers are made from
ORDERS, CUSTOMER, PART, LINEITEM = ("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("lineitem", "l_orderkey * 8 + l_linenumber")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(width: int, times: int = 982451653, key: str = "k") -> str:
    return f"lpad(cast(({key} * {times}) % {10**width} as string), {width}, '0')"


def letter(times: int = 7, letters: str = _UP, n: int = 26) -> str:
    return f"substr({letters}, cast((k * {times}) % {n} as int) + 1, 1)"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it has fewer partitions than there are; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def source(spark: SparkSession, sf_dir: str, of: tuple[str, str], value: str) -> DataFrame:
    return spread(_table(spark, sf_dir, of[0]).select(F.expr(f"cast({of[1]} as bigint)").alias("k"))).select("k", F.expr(value).alias("value"))


def source_sql(of: tuple[str, str], value: str) -> str:
    return f"SELECT k, {value} AS value FROM (SELECT cast({of[1]} AS bigint) AS k FROM {of[0]})"


# SQL that says what a rule says


def digits(x: str, chars: str = "'0123456789'") -> str:
    return f"({x} <> '' AND translate({x}, {chars}, '') = '')"


def wsum(x: str, weights: list[int], chars: str = "'0123456789'") -> str:
    return f"(CAST(list_sum([(strpos({chars}, substr({x}, i, 1)) - 1) * ({weights})[i] FOR i IN range(1, {len(weights)} + 1)]) AS BIGINT))"


def luhn(x: str) -> str:
    d = f"TRY_CAST(substr({x}, i, 1) AS BIGINT)"
    twice = f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"
    return f"(CAST(list_sum([CASE WHEN (length({x}) - i) % 2 = 1 THEN {twice} ELSE {d} END FOR i IN range(1, length({x}) + 1)]) AS BIGINT) % 10 = 0)"


def number_at(x: str, start: int, n: int) -> str:
    return f"TRY_CAST(substr({x}, {start}, {n}) AS BIGINT)"


def verdict(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'valid|ok' ELSE 'invalid|invalid_checksum' END"


NOT_PUBLISHED, NOT_SUPPORTED = "'unsupported|checksum_not_published'", "'unsupported|unsupported_checksum'"


def mapped(i: str, table: list[int]) -> str:
    return f"({table})[{i} + 1]"


class Case:
    """An identifier kind to validate: what to feed, and the rule as SQL over s."""

    def __init__(self, kind: str, value: str, canon: str, fails: list[tuple[str, str, str]], checksum: str, of=ORDERS, country: str | None = None, profile: str | None = None):
        self.kind, self.value, self.canon, self.fails, self.checksum, self.of, self.country, self.profile = kind, value, canon, fails, checksum, of, country, profile

    def on_tail(self, country: str) -> Case:
        """The EUID of a country whose national part is this case's."""
        key, tail = f"euid.{country.lower()}", "(CASE WHEN contains(s, '.') THEN substr(s, strpos(s, '.') + 1) END)"
        register = "(CASE WHEN strpos(s, '.') > 0 THEN substr(s, 3, greatest(strpos(s, '.') - 3, 0)) END)"
        value = f"concat(CASE WHEN k % 2 = 0 THEN '{country}' ELSE '{country.lower()}' END, CASE WHEN k % 17 = 1 THEN 'TOOLONGREG' WHEN k % 17 = 2 THEN 'R_1' ELSE 'R1' END, CASE WHEN k % 17 = 3 THEN '' ELSE '.' END, {self.value})"
        own = [
            ("contains(s, '.')", "invalid_format", f"{key}.separator"),
            (f"length({register}) BETWEEN 1 AND 8", "invalid_length", f"{key}.register_length"),
            (digits(register, _B36), "invalid_characters", f"{key}.register_characters"),
        ]
        moved = lambda sql: re.sub(r"\bs\b", tail, sql)
        return Case("euid", value, stripped("-" if country == "HU" else ""), [*own, *[(moved(holds), reason, k) for holds, reason, k in self.fails]], moved(self.checksum))

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir, self.of, self.value).withColumns({"kind": F.lit(self.kind), "country_code": F.lit(self.country).cast("string")})
        flat = api.flatten(api.validate(rows, profile=self.profile), "k")
        return flat.select("k", "canonical_value", "format_status", "format_reason_code", "format_message_key", "checksum_status", "checksum_reason_code")

    def sql(self, where: str = "true") -> str:
        fails = " ".join(f"WHEN NOT ({holds}) THEN '{reason}|{key}'" for holds, reason, key in self.fails)
        return f"""
WITH t AS (SELECT * FROM ({source_sql(self.of, self.value)}) WHERE {where}),
c AS (SELECT k, {self.canon} AS s FROM t),
f AS (SELECT k, s, CASE {fails} END AS fail FROM c),
r AS (SELECT k, s, fail, CASE WHEN fail IS NOT NULL THEN 'not_run|not_run_format_invalid' ELSE {self.checksum} END AS ck FROM f)
SELECT k, s AS canonical_value, CASE WHEN fail IS NULL THEN 'valid' ELSE 'invalid' END AS format_status,
  coalesce(split_part(fail, '|', 1), 'ok') AS format_reason_code, split_part(fail, '|', 2) AS format_message_key,
  split_part(ck, '|', 1) AS checksum_status, split_part(ck, '|', 2) AS checksum_reason_code FROM r"""


def family(cases: list[Case]) -> tuple[Query, str]:
    """Many kinds in one query: each key is asked for one of them."""
    n = len(cases)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = _table(spark, sf_dir, ORDERS[0]).select(F.expr(f"cast({ORDERS[1]} as bigint)").alias("k"))
        # one expression for all values would be more code than a method may hold
        each = [keys.where(f"k % {n} = {i}").select("k", F.expr(c.value).alias("value"), F.lit(c.kind).alias("kind"), F.lit(c.country).cast("string").alias("country_code")) for i, c in enumerate(cases)]
        flat = api.flatten(api.validate_checksum(spread(reduce(DataFrame.union, each))), "k")
        return flat.select("k", "canonical_value", "format_status", "format_reason_code", "format_message_key", "checksum_status", "checksum_reason_code")

    return query, "\nUNION ALL\n".join(f"SELECT * FROM ({c.sql(f'k % {n} = {i}')})" for i, c in enumerate(cases))


def stripped(chars: str = "-./_") -> str:
    return f"translate(translate(value, {_LETTERS}), '{chars}  ', '')"


def plain(key: str, lengths: str, chars: str = "'0123456789'", *more: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    return [("s <> ''", "empty", f"{key}.empty"), (f"length(s) {lengths}", "invalid_length", f"{key}.length"), (digits("s", chars), "invalid_characters", f"{key}.characters"), *more]


def vat(key: str, prefix: str, lengths: str, *more: tuple[str, str, str], body: bool = True) -> list[tuple[str, str, str]]:
    own = [("s <> ''", "empty", f"{key}.empty"), (f"length(s) {lengths}", "invalid_length", f"{key}.length"), (f"starts_with(s, '{prefix}')", "invalid_format", f"{key}.prefix")]
    return [*own, *([(digits("substr(s, 3)"), "invalid_characters", f"{key}.characters")] if body else []), *more]


#: now and then an identifier is spoilt: a character too few, a letter, nothing at all
def spoilt(value: str) -> str:
    return f"CASE WHEN k % 23 = 1 THEN substr({value}, 2) WHEN k % 29 = 2 THEN concat('x', substr({value}, 2)) WHEN k % 97 = 3 THEN ' ' ELSE {value} END"


def decorated(value: str) -> str:
    """Parted by blanks, hyphens, or a no-break space."""
    value = f"({spoilt(value)})"
    return f"CASE WHEN k % 4 = 0 THEN {value} WHEN k % 4 = 1 THEN concat(' ', substr({value}, 1, 3), '-', substr({value}, 4)) WHEN k % 4 = 2 THEN concat(substr({value}, 1, 5), ' ', substr({value}, 6), ' ') ELSE lower({value}) END"


_ENTITY, _CONTROL = "'ABCDEFGHJNPQRSUVW'", "'ABCDEFGHJKLMNPQRSTVWXYZ'"
_TEN0 = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0]
_LOW0 = [0, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1]
_F11 = [0, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1]
_CZ = [1, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1]
_LV = [3, 2, 1, 0, 10, 9, 8, 7, 6, 5, 4]
_F10 = [0, 9, 8, 7, 6, 5, 4, 3, 2, 1]
_CNPJ = "'0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_USCC = "'0123456789ABCDEFGHJKLMNPQRTUWXY'"
_MOD97 = "list_reduce([CASE WHEN strpos({b}, substr({x}, i, 1)) <= 10 THEN strpos({b}, substr({x}, i, 1)) - 1 ELSE 100 + strpos({b}, substr({x}, i, 1)) - 1 END FOR i IN range(0, length({x}) + 1)], lambda r, v: CASE WHEN v < 100 THEN (r * 10 + v) % 97 ELSE (r * 100 + v - 100) % 97 END)"


def mod97(x: str) -> str:
    # the list starts with place 0, an empty string, which strpos finds at 1: a zero
    return "(" + _MOD97.format(b=_B36, x=x) + ")"


def check_digit(x: str, weights: list[int], modulus: int, table: list[int], at: int, chars: str = "'0123456789'") -> str:
    return f"{mapped(f'({wsum(x, weights, chars)} % {modulus})', table)} = {number_at(x, at, 1)}"


def two_pass(x: str, first: list[int], second: list[int], at: int) -> str:
    a, b = f"({wsum(x, first)} % 11)", f"({wsum(x, second)} % 11)"
    return verdict(f"CASE WHEN {a} = 10 THEN {mapped(b, _TEN0)} ELSE {mapped(a, _TEN0)} END = {number_at(x, at, 1)}")


def _key_fr(s: str) -> str:
    return f"(12 + 3 * ({number_at(s, 5, 9)} % 97)) % 97 = {number_at(s, 3, 2)}"


_SIREN = plain("fr.siren", "= 9")
_SIREN_TAIL = [(f.replace("length(s)", "length(n)").replace("s <> ''", "n <> ''").replace("translate(s,", "translate(n,"), r, k) for f, r, k in _SIREN]
_FRENCH = "'0101','0202','0203','7501','7801','9201','9301','9401','6901','3302','1303','5902','4401','3102'"
_RO = [70, 50, 30, 20, 10, 70, 50, 30, 20]


def romanian(x: str) -> str:
    pad = f"lpad({x}, 10, '0')"  # weights go to the right end
    return verdict(check_digit(pad, _RO, 11, _TEN0, 10))


CASES: dict[str, Case] = {
    "validate_siren": Case("siren", decorated(number(9)), stripped(), _SIREN, verdict(luhn("s"))),
    "validate_siret": Case(
        "SIRET",
        f"CASE WHEN k % 3 = 0 THEN concat('356000000', {number(5)}) ELSE {decorated(number(14))} END",
        stripped(),
        plain("fr.siret", "= 14"),
        f"CASE WHEN NOT {luhn('substr(s, 1, 9)')} THEN 'invalid|invalid_checksum' WHEN starts_with(s, '356000000') THEN {verdict(f'({luhn("s")} OR {wsum("s", [1] * 14)} % 5 = 0)')} ELSE {verdict(luhn('s'))} END",
    ),
    "validate_cnpj": Case(
        "cnpj",
        decorated(f"concat({letter()}, {number(13)})"),
        stripped(),
        plain("cnpj", "= 14", _B36, (digits("substr(s, 13, 2)"), "invalid_characters", "cnpj.check_digits")),
        verdict(f"{check_digit('s', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], 11, _LOW0, 13, _CNPJ)} AND {check_digit('s', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], 11, _LOW0, 14, _CNPJ)}"),
    ),
    "validate_codice_fiscale": Case("codice_fiscale_impresa", decorated(number(11)), stripped(), plain("it.codice_fiscale_impresa", "= 11"), verdict(luhn("s"))),
    "validate_company_number": Case(
        "crn",
        f"CASE WHEN k % 3 = 0 THEN {number(8)} WHEN k % 3 = 1 THEN concat('SC', {number(6)}) ELSE concat({letter(3)}, {letter(5)}, {number(6)}) END",
        stripped(),
        plain("company_number", "= 8", _B36, (f"({digits('s')} OR substr(s, 1, 2) IN ('AC','CE','CS','EN','ES','FC','FE','GE','GN','GS','IC','IP','LP','NA','NC','NF','NI','NL','NO','NP','NR','NV','NZ','OC','OE','PC','R0','RC','RS','SA','SC','SE','SF','SG','SI','SL','SO','SP','SR','SZ','ZC'))", "invalid_format", "company_number.prefix")),
        NOT_PUBLISHED,
    ),
    "validate_corporate_number": Case("corporate_number", decorated(number(13)), stripped(), plain("corporate_number", "= 13"), verdict(f"{wsum('s', [1, 2] * 6 + [1])} % 9 = 0")),
    "validate_cui": Case("cui", f"CASE WHEN k % 3 = 0 THEN {number(10)} WHEN k % 3 = 1 THEN {number(6)} ELSE {spoilt(number(2))} END", stripped(), plain("ro.cui", "BETWEEN 2 AND 10"), romanian("s")),
    "validate_cvr": Case("cvr", decorated(number(8)), stripped(), plain("dk.cvr", "= 8", "'0123456789'", ("NOT starts_with(s, '0')", "invalid_format", "dk.cvr.leading")), verdict(f"{wsum('s', [2, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0")),
    "validate_duns": Case("duns", decorated(number(9)), stripped(), plain("duns", "= 9"), NOT_PUBLISHED, CUSTOMER),
    "validate_eik": Case("bulstat", f"CASE WHEN k % 5 = 0 THEN {number(13)} ELSE {decorated(number(9))} END", stripped(), plain("bg.eik", "IN (9, 13)"), two_pass("s", [1, 2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 9, 10], 9)),
    "validate_enterprise_number": Case(
        "enterprise_number",
        decorated(f"concat(cast(k % 3 as string), {number(9)})"),
        stripped(),
        plain("be.enterprise_number", "= 10", "'0123456789'", ("(starts_with(s, '0') OR starts_with(s, '1'))", "invalid_format", "be.enterprise_number.leading")),
        verdict(f"97 - {number_at('s', 1, 8)} % 97 = {number_at('s', 9, 2)}"),
    ),
    "validate_eori": Case("eori", decorated(f"concat({letter(3)}, {letter(5)}, {number(12)})"), stripped(), plain("eori", "BETWEEN 3 AND 17", _B36, (digits("substr(s, 1, 2)", _UP), "invalid_format", "eori.country_prefix")), NOT_PUBLISHED, CUSTOMER),
    "validate_firmenbuchnummer": Case(
        "fn",
        f"concat({spoilt(number(5))}, {letter()}, CASE WHEN k % 7 = 0 THEN '1' ELSE '' END)",
        stripped(),
        plain("at.firmenbuchnummer", "BETWEEN 2 AND 7", _B36, (f"({digits('substr(s, 1, length(s) - 1)')} AND {digits('substr(s, length(s), 1)', _UP)})", "invalid_format", "at.firmenbuchnummer.shape")),
        NOT_PUBLISHED,
        CUSTOMER,
    ),
    "validate_ico_cz": Case("ico", decorated(number(8)), stripped(), plain("cz.ico", "= 8"), verdict(check_digit("s", [8, 7, 6, 5, 4, 3, 2], 11, _CZ, 8)), country="cz"),
    "validate_juridinio": Case(
        "juridinio_asmens_kodas",
        decorated(number(9)),
        stripped(),
        plain("lt.juridinio_asmens_kodas", "= 9"),
        verdict(f"CASE WHEN {wsum('s', [1, 2, 3, 4, 5, 6, 7, 8, 9])} % 11 = 10 THEN {mapped(f'({wsum("s", [3, 4, 5, 6, 7, 8, 9, 1, 2])} % 11)', _TEN0)} ELSE {wsum('s', [1, 2, 3, 4, 5, 6, 7, 8, 9])} % 11 END = 0"),
    ),
    "validate_lei": Case(
        "lei", f"concat({letter()}, {number(17)}, CASE WHEN k % 5 = 0 THEN 'A' ELSE '' END, cast(10 + k % 89 as string))", stripped(), plain("lei", "= 20", _B36, (digits("substr(s, 19, 2)"), "invalid_characters", "lei.check_digits")), verdict(f"{mod97('s')} = 1")
    ),
    "validate_nif": Case(
        "nif",
        decorated(f"concat({letter()}, {number(7)}, CASE WHEN k % 3 = 0 THEN {letter(11)} ELSE cast(k % 10 as string) END)"),
        stripped(),
        plain("es.nif", "= 9", _B36, (digits("substr(s, 1, 1)", "'ABCDEFGHJNPQRSUVW'"), "invalid_format", "es.nif.legal_entity"), (digits("substr(s, 2, 7)"), "invalid_characters", "es.nif.body")),
        f"CASE WHEN {digits('substr(s, 9, 1)')} THEN {verdict(luhn('substr(s, 2)'))} ELSE {NOT_PUBLISHED} END",
    ),
    "validate_nipc": Case("nipc", decorated(number(9)), stripped(), plain("pt.nipc", "= 9"), verdict(check_digit("s", [9, 8, 7, 6, 5, 4, 3, 2], 11, _LOW0, 9))),
    "validate_organisationsnummer": Case("organisationsnummer", decorated(number(10)), stripped(), plain("se.organisationsnummer", "= 10", "'0123456789'", ("substr(s, 3, 1) >= '2'", "invalid_format", "se.organisationsnummer.group")), verdict(luhn("s"))),
    "validate_registracijas": Case("registracijas_numurs", decorated(number(11)), stripped(), plain("lv.registracijas_numurs", "= 11", "'0123456789'", ("substr(s, 1, 1) >= '4'", "invalid_format", "lv.registracijas_numurs.legal_entity")), verdict(check_digit("s", [9, 1, 4, 8, 3, 10, 2, 5, 7, 6], 11, _LV, 11))),
    "validate_registrikood": Case("registrikood", decorated(number(8)), stripped(), plain("ee.registrikood", "= 8"), two_pass("s", [1, 2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7, 8, 9], 8)),
    "validate_uscc": Case("uscc", decorated(f"concat({number(9)}, {letter(7, _USCC, 31)}, {number(7, 7919)}, {letter(13, _USCC, 31)})"), stripped(), plain("uscc", "= 18", _USCC), verdict(f"{wsum('s', [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28, 1], _USCC)} % 31 = 0")),
    "validate_y_tunnus": Case("y_tunnus", decorated(number(8)), stripped(), plain("fi.y_tunnus", "= 8"), verdict(check_digit("s", [7, 9, 10, 5, 8, 4, 2], 11, _F11, 8))),
    "validate_vat_be": Case(
        "vat",
        f"concat('be ', CASE WHEN k % 2 = 0 THEN {number(9)} ELSE concat(cast(k % 4 as string), {number(9)}) END)",
        f"CASE WHEN length({stripped()}) = 11 THEN concat(substr({stripped()}, 1, 2), '0', substr({stripped()}, 3)) ELSE {stripped()} END",
        vat("vat.be", "BE", "= 12", ("substr(s, 3, 1) IN ('0', '1')", "invalid_format", "vat.be.enterprise_prefix")),
        verdict(f"97 - {number_at('s', 3, 8)} % 97 = {number_at('s', 11, 2)}"),
    ),
    "validate_vat_bg": Case("vat", f"concat('BG', {number(9)}, CASE WHEN k % 5 = 0 THEN '7' WHEN k % 7 = 0 THEN 'X' ELSE '' END)", stripped(), vat("vat.bg", "BG", "IN (11, 12)"), f"CASE WHEN length(s) <> 11 THEN {NOT_PUBLISHED} ELSE {two_pass('substr(s, 3)', [1, 2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 9, 10], 9)} END"),
    "validate_vat_de": Case("vat", f"concat('DE', {number(9)}, CASE WHEN k % 7 = 0 THEN 'X' ELSE '' END)", stripped(), vat("vat.de", "DE", "= 11"), NOT_SUPPORTED, CUSTOMER),
    "validate_vat_ee": Case("vat", f"concat('EE', {number(9)})", stripped(), vat("vat.ee", "EE", "= 11"), verdict(check_digit("substr(s, 3)", [3, 7, 1, 3, 7, 1, 3, 7], 10, _F10, 9))),
    "validate_vat_fr": Case(
        "vat",
        f"concat(CASE WHEN k % 3 = 0 THEN '' ELSE 'FR' END, CASE WHEN k % 5 = 0 THEN concat({letter()}, '7') ELSE lpad(cast((12 + 3 * (((k * 982451653) % 1000000000) % 97) + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) % 97 as string), 2, '0') END, {number(9)})",
        f"CASE WHEN starts_with({stripped()}, 'FR') THEN {stripped()} ELSE concat('FR', {stripped()}) END",
        [*vat("vat.fr", "FR", "= 13", body=False), (digits("substr(s, 3, 2)", _B36), "invalid_characters", "vat.fr.key_characters"), (digits("substr(s, 5)"), "invalid_characters", "vat.fr.siren_characters")],
        f"CASE WHEN NOT {luhn('substr(s, 5)')} THEN 'invalid|invalid_checksum' WHEN {digits('substr(s, 3, 2)')} THEN {verdict(_key_fr('s'))} ELSE {NOT_PUBLISHED} END",
        country="fr",
    ),
    "validate_vat_fr_strict": Case(
        "vat",
        f"concat('FR', CASE WHEN k % 5 = 0 THEN concat({letter()}, '7') ELSE {number(2, 7919)} END, {number(9)})",
        stripped(),
        [*vat("vat.fr", "FR", "= 13", body=False), (digits("substr(s, 3, 2)"), "invalid_characters", "vat.fr.key_characters"), (digits("substr(s, 5)"), "invalid_characters", "vat.fr.siren_characters")],
        f"CASE WHEN NOT {luhn('substr(s, 5)')} THEN 'invalid|invalid_checksum' ELSE {verdict(_key_fr('s'))} END",
        profile="strict_current",
    ),
    "validate_vat_gb": Case("vat", f"concat('GB', {number(9)}, CASE WHEN k % 5 = 0 THEN '123' ELSE '' END)", stripped(), vat("vat.gb", "GB", "IN (11, 14)"), verdict(f"{wsum('substr(s, 3)', [8, 7, 6, 5, 4, 3, 2, 10, 1])} % 97 IN (0, 42)"), country="uk"),
    "validate_vat_gr": Case(
        "vat",
        f"concat(CASE WHEN k % 2 = 0 THEN 'GR' ELSE 'EL' END, {number(9)})",
        f"CASE WHEN starts_with({stripped()}, 'GR') THEN concat('EL', substr({stripped()}, 3)) ELSE {stripped()} END",
        vat("vat.gr", "EL", "= 11"),
        verdict(check_digit("substr(s, 3)", [256, 128, 64, 32, 16, 8, 4, 2], 11, _TEN0, 9)),
    ),
    "validate_vat_ie": Case(
        "vat",
        f"concat('IE', {number(1)}, CASE WHEN k % 3 = 0 THEN {letter(3)} ELSE '4' END, {number(5)}, {letter(5)}, CASE WHEN k % 5 = 0 THEN 'A' ELSE '' END)",
        stripped(),
        [
            *vat("vat.ie", "IE", "BETWEEN 10 AND 11", body=False),
            (digits("substr(s, 3)", _B36), "invalid_characters", "vat.ie.characters"),
            (f"((length(s) = 10 AND {digits('substr(s, 3, 7)')} AND {digits('substr(s, 10, 1)', _UP)}) OR (length(s) = 11 AND {digits('substr(s, 3, 7)')} AND {digits('substr(s, 10, 2)', _UP)}) OR (length(s) = 10 AND {digits('substr(s, 3, 1)')} AND {digits('substr(s, 4, 1)', _UP)} AND {digits('substr(s, 5, 5)')} AND {digits('substr(s, 10, 1)', _UP)}))", "invalid_format", "vat.ie.shape"),
        ],
        NOT_SUPPORTED,
    ),
    "validate_vat_lu": Case("vat", f"concat('LU', {number(8)})", stripped(), vat("vat.lu", "LU", "= 10"), verdict(f"{number_at('s', 3, 6)} % 89 = {number_at('s', 9, 2)}"), LINEITEM),
    "validate_vat_lv": Case("vat", f"concat('LV', {number(11)})", stripped(), vat("vat.lv", "LV", "= 13"), f"CASE WHEN substr(s, 3, 1) < '4' THEN {NOT_PUBLISHED} ELSE {verdict(check_digit('substr(s, 3)', [9, 1, 4, 8, 3, 10, 2, 5, 7, 6], 11, _LV, 11))} END"),
    "validate_vat_mt": Case("vat", f"concat('MT', {number(8)})", stripped(), vat("vat.mt", "MT", "= 10"), verdict(f"37 - {wsum('substr(s, 3)', [3, 4, 6, 7, 8, 9])} % 37 = {number_at('s', 9, 2)}"), LINEITEM),
    "validate_vat_nl": Case(
        "vat",
        f"concat('NL', {number(9)}, CASE WHEN k % 6 = 0 THEN 'C' ELSE 'B' END, {number(2)})",
        stripped(),
        [
            *vat("vat.nl", "NL", "= 14", body=False),
            (digits("substr(s, 13)"), "invalid_characters", "vat.nl.characters"),
            ("substr(s, 12, 1) = 'B'", "invalid_format", "vat.nl.b_marker"),
            (digits("substr(s, 3, 9)"), "invalid_characters", "vat.nl.body_characters"),
            (digits("substr(s, 13, 2)"), "invalid_characters", "vat.nl.sub_characters"),
        ],
        verdict(check_digit("substr(s, 3)", [9, 8, 7, 6, 5, 4, 3, 2], 11, [*_TEN0[:10], 10], 9)),
    ),
    "validate_vat_ro": Case("vat", f"concat('RO', CASE WHEN k % 3 = 0 THEN {number(10)} ELSE {number(4)} END)", stripped(), vat("vat.ro", "RO", "BETWEEN 4 AND 12"), romanian("substr(s, 3)")),
    "validate_vat_se": Case("vat", f"concat('SE', {number(10)}, CASE WHEN k % 4 = 0 THEN '00' ELSE '01' END)", stripped(), vat("vat.se", "SE", "= 14", ("substr(s, 13, 2) <> '00'", "invalid_format", "vat.se.branch")), verdict(luhn("substr(s, 3, 10)"))),
    "validate_vat_sk": Case("vat", f"concat('SK', {number(10)})", stripped(), vat("vat.sk", "SK", "= 12"), verdict(f"{number_at('s', 3, 10)} % 11 = 0")),
    "validate_euid_fr": Case(
        "euid",
        f"concat('fr', CASE WHEN k % 4 = 0 THEN '9999' WHEN k % 4 = 1 THEN '7501' WHEN k % 4 = 2 THEN '0101' ELSE '75' END, CASE WHEN k % 11 = 0 THEN '' ELSE '.' END, {number(9)})",
        f"translate(translate(value, {_LETTERS}), ' ', '')",
        [
            ("s <> ''", "empty", "euid.fr.empty"),
            ("starts_with(s, 'FR')", "invalid_format", "euid.fr.prefix"),
            ("contains(s, '.')", "invalid_format", "euid.fr.separator"),
            ("strpos(s, '.') = 7", "invalid_length", "euid.fr.register_length"),
            (digits("substr(s, 3, 4)"), "invalid_characters", "euid.fr.register_characters"),
            (f"substr(s, 3, 4) IN ({_FRENCH})", "invalid_format", "euid.fr.register_unknown"),
            *[(f.replace("length(n)", "length(substr(s, 8))").replace("n <> ''", "substr(s, 8) <> ''").replace("translate(n,", "translate(substr(s, 8),"), r, k) for f, r, k in _SIREN_TAIL],
        ],
        verdict(luhn("substr(s, 8)")),
    ),
    "validate_euid_be": Case(
        "euid",
        f"concat('BEKBO.', CASE WHEN k % 5 = 0 THEN '2' ELSE '0' END, {number(9)})",
        f"translate(translate(value, {_LETTERS}), ' ', '')",
        [("length(substr(s, 7)) = 10", "invalid_length", "be.enterprise_number.length"), ("substr(s, 7, 1) IN ('0', '1')", "invalid_format", "be.enterprise_number.leading")],
        verdict(f"97 - {number_at('s', 7, 8)} % 97 = {number_at('s', 15, 2)}"),
    ),
}


# the definitions that have no query of their own, many to a query
_CZ_SUM, _NATIONAL_F11 = check_digit("s", [8, 7, 6, 5, 4, 3, 2], 11, _CZ, 8), [3, 2, 7, 6, 5, 4, 3, 2]
NATIONAL: dict[str, Case] = {
    "HU": Case("hu_cegjegyzekszam", decorated(number(10)), stripped(), plain("hu.cegjegyzekszam", "= 10"), NOT_PUBLISHED),
    "IE": Case("cro_number", decorated(f"CASE WHEN k % 2 = 0 THEN {number(6)} ELSE {number(8)} END"), stripped(), plain("ie.cro_number", "BETWEEN 5 AND 7"), NOT_PUBLISHED),
    "US": Case("us_ein", decorated(number(9)), stripped(), plain("ein", "= 9"), NOT_PUBLISHED),
    "EL": Case("gemi", decorated(number(12)), stripped(), plain("el.gemi", "= 12"), NOT_PUBLISHED),
    "DE": Case("hrb", decorated(f"concat('HRB', {number(6)}, CASE WHEN k % 19 = 4 THEN 'ü' ELSE '' END)"), stripped(), plain("de.handelsregisternummer", "BETWEEN 1 AND 20", _B36), NOT_PUBLISHED),
    "CY": Case("he_number", decorated(number(6)), stripped(), plain("cy.he_number", "= 6"), NOT_PUBLISHED),
    "SK": Case("ico", decorated(number(8)), stripped(), plain("sk.ico", "= 8"), verdict(_CZ_SUM), country="SK"),
    "PL": Case("krs", decorated(number(10)), stripped(), plain("pl.krs", "= 10"), NOT_PUBLISHED),
    "NL": Case("nl_kvk", decorated(number(8)), stripped(), plain("nl.kvk", "= 8"), NOT_PUBLISHED),
    "SI": Case("maticna_stevilka", decorated(number(7)), stripped(), plain("si.maticna_stevilka", "= 7"), NOT_PUBLISHED),
    "MT": Case(
        "mbr_number",
        decorated(f"concat(CASE WHEN k % 7 = 0 THEN 'D' ELSE 'C' END, {number(5)})"),
        stripped(),
        [*plain("mt.mbr_number", "BETWEEN 5 AND 7")[:2], ("starts_with(s, 'C')", "invalid_format", "mt.mbr_number.prefix"), (digits("substr(s, 2)"), "invalid_characters", "mt.mbr_number.characters")],
        NOT_PUBLISHED,
    ),
    "HR": Case("mbs", decorated(number(8)), stripped(), plain("hr.mbs", "= 8"), NOT_PUBLISHED),
    "LU": Case(
        "rcs_number",
        decorated(f"concat(CASE WHEN k % 7 = 0 THEN '1' ELSE {letter()} END, {number(5)})"),
        stripped(),
        [*plain("lu.rcs_number", "BETWEEN 5 AND 7")[:2], (digits("substr(s, 1, 1)", _UP), "invalid_format", "lu.rcs_number.prefix"), (digits("substr(s, 2)"), "invalid_characters", "lu.rcs_number.characters")],
        NOT_PUBLISHED,
    ),
}


def _vat_case(country: str, body: str, lengths: str, checksum: str, *more: tuple[str, str, str], numeric: bool = True, asked: str | None = None) -> Case:
    return Case("vat_number", f"concat('{country}', {spoilt(body)})", stripped(), vat(f"vat.{country.lower()}", country, lengths, *more, body=numeric), checksum, country=asked or country.lower())


def _british() -> str:
    return verdict(f"{wsum('substr(s, 3)', [8, 7, 6, 5, 4, 3, 2, 10, 1])} % 97 IN (0, 42)")


def _only(length: int, checksum: str) -> str:
    return f"CASE WHEN length(s) <> {length} THEN {NOT_PUBLISHED} ELSE {checksum} END"


_ES_SHAPE = f"(({digits('substr(s, 3, 1)', _ENTITY)} AND {digits('substr(s, 4, 7)')}) OR ({digits('substr(s, 3, 8)')} AND {digits('substr(s, 11, 1)', _CONTROL)}) OR (substr(s, 3, 1) IN ('X', 'Y', 'Z') AND {digits('substr(s, 4, 7)')} AND {digits('substr(s, 11, 1)', _CONTROL)}))"
VAT: list[Case] = [
    _vat_case("AT", f"concat(CASE WHEN k % 5 = 0 THEN 'X' ELSE 'U' END, {number(8)})", "= 11", NOT_SUPPORTED, (digits("substr(s, 4)"), "invalid_characters", "vat.at.characters"), ("substr(s, 3, 1) = 'U'", "invalid_format", "vat.at.u_marker"), numeric=False),
    _vat_case("CY", f"concat({number(8)}, CASE WHEN k % 5 = 0 THEN '1' ELSE {letter()} END)", "= 11", NOT_SUPPORTED, (digits("substr(s, 11, 1)", _UP), "invalid_format", "vat.cy.check_letter"), (digits("substr(s, 3, 8)"), "invalid_characters", "vat.cy.body_characters"), numeric=False),
    _vat_case("CZ", f"CASE WHEN k % 5 = 0 THEN {number(10)} ELSE {number(8)} END", "BETWEEN 10 AND 12", _only(10, verdict(check_digit("substr(s, 3)", [8, 7, 6, 5, 4, 3, 2], 11, _CZ, 8)))),
    _vat_case("DK", number(8), "= 10", verdict(f"{wsum('substr(s, 3)', [2, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0")),
    _vat_case(
        "ES",
        f"CASE WHEN k % 4 = 0 THEN concat({letter()}, {number(8)}) WHEN k % 4 = 1 THEN concat({number(8)}, {letter()}) WHEN k % 4 = 2 THEN concat('Y', {number(7)}, {letter()}) ELSE concat('B', {number(7)}, {letter()}) END",
        "= 11",
        f"CASE WHEN {digits('substr(s, 3, 1)', _ENTITY)} AND {digits('substr(s, 11, 1)')} THEN {verdict(luhn('substr(s, 4, 8)'))} ELSE {NOT_PUBLISHED} END",
        (digits("substr(s, 3)", _B36), "invalid_characters", "vat.es.characters"),
        (_ES_SHAPE, "invalid_format", "vat.es.shape"),
        numeric=False,
    ),
    _vat_case("FI", number(8), "= 10", verdict(check_digit("substr(s, 3)", [7, 9, 10, 5, 8, 4, 2], 11, _F11, 8))),
    _vat_case("HR", number(11), "= 13", NOT_SUPPORTED),
    _vat_case("HU", number(8), "= 10", verdict(check_digit("substr(s, 3)", [9, 7, 3, 1, 9, 7, 3], 10, _F10, 8))),
    _vat_case("IS", f"CASE WHEN k % 3 = 0 THEN {number(5)} WHEN k % 3 = 1 THEN {number(6)} ELSE {number(10)} END", "IN (7, 8, 12)", _only(12, verdict(check_digit("substr(s, 3)", _NATIONAL_F11, 11, _F11, 9)))),
    _vat_case("IT", number(11), "= 13", verdict(luhn("substr(s, 3)"))),
    _vat_case("LI", number(5), "= 7", NOT_PUBLISHED),
    _vat_case("NO", number(9), "= 11", verdict(check_digit("substr(s, 3)", _NATIONAL_F11, 11, _F11, 9))),
    _vat_case("PL", number(10), "= 12", verdict(check_digit("substr(s, 3)", [6, 5, 7, 2, 3, 4, 5, 6, 7], 11, [*_TEN0[:10], 10], 10))),
    _vat_case("PT", number(9), "= 11", verdict(check_digit("substr(s, 3)", [9, 8, 7, 6, 5, 4, 3, 2], 11, _LOW0, 9))),
    _vat_case("SI", number(8), "= 10", verdict(check_digit("substr(s, 3)", [8, 7, 6, 5, 4, 3, 2], 11, _F11, 8))),
    _vat_case("XI", f"concat({number(9)}, CASE WHEN k % 5 = 0 THEN '123' ELSE '' END)", "IN (11, 14)", _british()),
]

#: EUIDs by country, with the case of their national part. The German one needs a list of courts.
_PARTS = {"AT": "firmenbuchnummer", "BG": "eik", "CZ": "ico_cz", "DK": "cvr", "EE": "registrikood", "ES": "nif", "FI": "y_tunnus", "IT": "codice_fiscale", "LT": "juridinio", "LV": "registracijas", "PT": "nipc", "RO": "cui", "SE": "organisationsnummer"}
EUID: list[Case] = [
    *[CASES[f"validate_{name}"].on_tail(country) for country, name in _PARTS.items()],
    *[NATIONAL[c].on_tail(c) for c in ("CY", "EL", "HR", "HU", "IE", "LU", "MT", "NL", "PL", "SI", "SK")],
]
FAMILIES: dict[str, tuple[Query, str]] = {"validate_national": family(list(NATIONAL.values())), "validate_vat_more": family(VAT), "validate_euid_more": family(EUID)}

#: Courts of a German register, as a caller gives them: a list to be told from others.
COURTS = ("B1000", "K1101R", "M1201")
_DE_VALUE = f"concat('DE', CASE WHEN k % 5 = 0 THEN 'ZZZZZ' WHEN k % 5 = 1 THEN 'k1101r' WHEN k % 5 = 2 THEN 'B1000' WHEN k % 5 = 3 THEN 'B10' ELSE 'M1201' END, CASE WHEN k % 13 = 0 THEN '' ELSE '.' END, 'HRB', {number(6)}, CASE WHEN k % 17 = 0 THEN repeat('9', 20) ELSE '' END)"
_DE_REGISTER, _DE_TAIL = "(CASE WHEN contains(s, '.') THEN substr(s, 3, strpos(s, '.') - 3) END)", "substr(s, strpos(s, '.') + 1)"
_DE_CASE = Case(
    "euid",
    _DE_VALUE,
    stripped(""),
    [
        ("contains(s, '.')", "invalid_format", "euid.de.separator"),
        (f"length({_DE_REGISTER}) BETWEEN 5 AND 6", "invalid_length", "euid.de.register_length"),
        (f"{_DE_REGISTER} IN {COURTS}", "invalid_format", "euid.de.register_unknown"),
        (f"length({_DE_TAIL}) BETWEEN 1 AND 20", "invalid_length", "de.handelsregisternummer.length"),
    ],
    NOT_PUBLISHED,
)


def validate_euid_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list of courts: what is on it is valid, what is not is invalid."""
    rows = source(spark, sf_dir, ORDERS, _DE_VALUE).withColumns({"kind": F.lit("euid"), "country_code": F.lit(None).cast("string")})
    flat = api.flatten(api.validate(rows, registers=api.Registers(german=COURTS)), "k")
    return flat.select("k", "canonical_value", "format_status", "format_reason_code", "format_message_key", "checksum_status", "checksum_reason_code")


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.capabilities(spark)


# dispatch


def _asked(spark: SparkSession, sf_dir: str, value: str, kind: str, country: str) -> DataFrame:
    return source(spark, sf_dir, CUSTOMER, value).withColumns({"kind": F.expr(kind), "country_code": F.expr(country)})


_D_VALUE = f"CASE WHEN k % 5 = 0 THEN repeat('1', 1025) WHEN k % 5 = 1 THEN concat('BE', {number(10)}) WHEN k % 5 = 2 THEN concat('GR', {number(9)}) WHEN k % 5 = 3 THEN {number(9)} ELSE ' x-1 ' END"
_D_KIND = "CASE WHEN k % 7 = 0 THEN ' VAT_ID ' WHEN k % 7 = 1 THEN 'siren' WHEN k % 7 = 2 THEN 'dnb' WHEN k % 7 = 3 THEN 'nothing' WHEN k % 7 = 4 THEN cast(NULL as string) ELSE 'vat' END"
_D_COUNTRY = "CASE WHEN k % 11 = 0 THEN 'be' WHEN k % 11 = 1 THEN ' EL ' WHEN k % 11 = 2 THEN 'FR' WHEN k % 11 = 3 THEN 'Belgium' WHEN k % 11 = 4 THEN 'ZZ' WHEN k % 11 = 5 THEN '  ' ELSE cast(NULL as string) END"


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.canonicalize(_asked(spark, sf_dir, _D_VALUE, _D_KIND, _D_COUNTRY))
    c = lambda n: F.col(f"canonicalization.{n}").alias(n)
    return found.select("k", c("kind"), c("canonical_value"), c("country_code"), c("profile"), c("status"), c("reason_code"))


DISPATCH_SQL = f"""
WITH a AS (SELECT k, {_D_VALUE} AS value, {_D_KIND} AS kind, {_D_COUNTRY} AS country FROM (SELECT c_custkey AS k FROM customer)),
b AS (SELECT *, lower(trim(kind)) AS token, upper(trim(country)) AS ct, translate(upper(value), ' -./_', '') AS pre FROM a),
c AS (SELECT *, CASE token WHEN 'vat' THEN 'vat' WHEN 'vat_id' THEN 'vat' WHEN 'siren' THEN 'siren' WHEN 'dnb' THEN 'duns' END AS known, nullif(ct, '') AS given FROM b),
d AS (SELECT *, CASE WHEN known = 'vat' AND given = 'EL' THEN 'GR' ELSE given END AS resolved,
  CASE WHEN known = 'vat' AND given IN ('BE', 'FR') THEN given WHEN known = 'vat' AND given = 'EL' THEN 'GR' WHEN known = 'siren' AND given = 'FR' THEN 'FR' END AS by_country,
  CASE WHEN known = 'vat' AND substr(pre, 1, 2) IN ('BE', 'GR') THEN substr(pre, 1, 2) END AS by_prefix FROM c),
e AS (SELECT *, CASE WHEN strlen(value) > 1024 THEN 'input_too_long' WHEN known IS NULL THEN 'unsupported_kind' WHEN given IS NOT NULL AND length(given) <> 2 THEN 'unsupported_country'
  WHEN given IS NOT NULL AND by_country IS NULL AND known <> 'duns' THEN 'unsupported_country' WHEN by_country <> by_prefix THEN 'country_mismatch'
  WHEN known = 'vat' AND coalesce(by_country, by_prefix) IS NULL THEN 'missing_country_code' END AS failed,
  CASE WHEN known = 'siren' THEN 'FR' ELSE coalesce(by_country, by_prefix) END AS target FROM d)
SELECT k, CASE WHEN failed IN ('input_too_long', 'unsupported_kind') THEN token ELSE known END AS kind,
  CASE WHEN failed IN ('input_too_long', 'unsupported_kind') THEN value WHEN failed IS NOT NULL OR known <> 'vat' THEN pre
    WHEN target = 'GR' THEN CASE WHEN substr(pre, 1, 2) = 'GR' THEN concat('EL', substr(pre, 3)) ELSE concat('EL', pre) END
    WHEN starts_with(pre, target) THEN CASE WHEN target = 'BE' AND length(pre) = 11 THEN concat('BE0', substr(pre, 3)) ELSE pre END
    WHEN target = 'BE' AND length(pre) = 9 THEN concat('BE0', pre) ELSE concat(target, pre) END AS canonical_value,
  CASE WHEN failed IN ('input_too_long', 'unsupported_kind') THEN country WHEN failed = 'unsupported_country' AND length(given) <> 2 THEN country
    WHEN failed IS NOT NULL THEN resolved WHEN known = 'duns' THEN given ELSE target END AS country_code,
  'compatible' AS profile, CASE WHEN failed = 'country_mismatch' THEN 'invalid' WHEN failed IS NOT NULL THEN 'unsupported' ELSE 'valid' END AS status, coalesce(failed, 'ok') AS reason_code
FROM e"""


def format_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, CUSTOMER, spoilt(number(9))).withColumns({"kind": F.lit("siren"), "country_code": F.lit("FR")})
    return api.flatten(api.validate_format(rows), "k").select("k", "format_status", "checksum_status", "checksum_reason_code", *["is_format_valid", "is_checksum_valid", "is_fully_validated", "is_invalid"])


FORMAT_ONLY_SQL = f"""
WITH t AS ({source_sql(CUSTOMER, spoilt(number(9)))}), v AS (SELECT k, length(trim(value)) = 9 AND {digits('trim(value)')} AS ok FROM t)
SELECT k, CASE WHEN ok THEN 'valid' ELSE 'invalid' END AS format_status, 'not_run' AS checksum_status,
  CASE WHEN ok THEN 'not_requested' ELSE 'not_run_format_invalid' END AS checksum_reason_code, ok AS is_format_valid, false AS is_checksum_valid, false AS is_fully_validated, NOT ok AS is_invalid FROM v"""


def rules_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.rules_info(spark).select("rules_version", "format_version", "engine_version", "definition_count", "country_count", F.array_join("kinds", ",").alias("kinds"))


RULES_INFO_SQL = """
SELECT '2026.08.38' AS rules_version, 1 AS format_version, '0.1.0' AS engine_version, 94 AS definition_count, 37 AS country_count,
'cegjegyzekszam,cnpj,codice_fiscale_impresa,company_number,corporate_number,cro_number,cui,cvr,duns,eik,ein,enterprise_number,eori,euid,firmenbuchnummer,gemi,handelsregisternummer,he_number,ico,juridinio_asmens_kodas,krs,kvk,lei,maticna_stevilka,mbr_number,mbs,nif,nipc,organisationsnummer,rcs_number,registracijas_numurs,registrikood,siren,siret,uscc,vat,y_tunnus' AS kinds"""


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, LINEITEM, decorated(number(9))).withColumns({"kind": F.expr("CASE WHEN k % 2 = 0 THEN 'siren' ELSE 'nipc' END"), "country_code": F.lit(None).cast("string")})
    return api.verdict_summary(api.validate(rows))


def _summary_sql() -> str:
    parts = []
    for kind, ck, odd in (("siren", luhn("s"), 0), ("nipc", check_digit("s", [9, 8, 7, 6, 5, 4, 3, 2], 11, _LOW0, 9), 1)):
        parts.append(f"SELECT '{kind}' AS kind, length(s) = 9 AND {digits('s')} AS ok, {ck} AS ck FROM c WHERE k % 2 = {odd}")
    return f"""
WITH t AS ({source_sql(LINEITEM, decorated(number(9)))}), c AS (SELECT k, {stripped()} AS s FROM t), v AS ({" UNION ALL ".join(parts)})
SELECT kind, CASE WHEN ok THEN 'valid' ELSE 'invalid' END AS format_status, CASE WHEN NOT ok THEN 'not_run' WHEN ck THEN 'valid' ELSE 'invalid' END AS checksum_status, count(*) AS n FROM v GROUP BY ALL"""


# operators on their own


def _operators(of: tuple[str, str], value: str, columns: dict[str, tuple[Callable[[Column], Column], str]]) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("value")
        return source(spark, sf_dir, of, value).select("k", *[f(v).alias(n) for n, (f, _) in columns.items()])

    return query, f"SELECT k, {', '.join(f'{sql} AS {n}' for n, (_, sql) in columns.items())} FROM ({source_sql(of, value)})"


_V = "CASE WHEN k % 13 = 0 THEN cast(NULL as string) WHEN k % 7 = 0 THEN '' ELSE concat(" + letter() + ", " + number(6) + ", CASE WHEN k % 3 = 0 THEN '.x' ELSE '' END) END"
_D = "CASE WHEN k % 13 = 0 THEN cast(NULL as string) WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN concat(' ', " + number(6) + ") ELSE " + number(12) + " END"
_I = lambda s: s.try_cast("bigint")
_dig = digits("value")
_n = "CAST(CASE WHEN " + _dig + " THEN TRY_CAST(value AS BIGINT) END AS BIGINT)"


def _status(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.concat_ws("|", f(v)["status"], f(v)["reason_code"])


_mod11 = lambda v: integers.modulo(integers.digits_to_integer(v), 11)
_cd = lambda v: outcomes.compare_digit(_mod11(v), v, 3)
_cc = lambda v: outcomes.compare_constant(_mod11(v), 4)
_sql_m = f"({_n} % 11)"
_sql_cd = f"CASE WHEN NOT {_dig} OR value IS NULL OR length(value) < 4 THEN 'unsupported|unsupported_checksum' WHEN {_sql_m} = {number_at('value', 4, 1)} THEN 'valid|ok' ELSE 'invalid|invalid_checksum' END"
_sql_cc = f"CASE WHEN {_n} IS NULL THEN 'unsupported|unsupported_checksum' WHEN {_sql_m} = 4 THEN 'valid|ok' ELSE 'invalid|invalid_checksum' END"

OPERATORS: dict[str, tuple[Query, str]] = {
    "op_string_views": _operators(
        ORDERS,
        _V,
        {
            "constant": (lambda v: strings.constant("x"), "'x'"),
            "whole": (strings.value, "value"),
            "subject": (lambda v: strings.subject(None, strings.slice_from(v, 1), v), "CASE WHEN length(value) >= 1 THEN substr(value, 2) END"),
            "country": (lambda v: strings.country_code(F.lit("FR")), "'FR'"),
            "sliced": (lambda v: strings.slice_(v, 1, 4), "CASE WHEN length(value) >= 4 THEN substr(value, 2, 3) END"),
            "suffix": (lambda v: strings.slice_from(v, 7), "CASE WHEN length(value) >= 7 THEN substr(value, 8) END"),
            "head": (lambda v: strings.slice_to(v, 3), "CASE WHEN length(value) >= 3 THEN substr(value, 1, 3) END"),
            "before_dot": (lambda v: strings.before_first(v, "."), "CASE WHEN contains(value, '.') THEN split_part(value, '.', 1) END"),
            "after_dot": (lambda v: strings.after_first(v, "."), "CASE WHEN contains(value, '.') THEN substr(value, strpos(value, '.') + 1) END"),
            "bare": (lambda v: strings.strip_prefix(v, "H"), "CASE WHEN starts_with(value, 'H') THEN substr(value, 2) END"),
            "joined": (lambda v: strings.concat(v, F.lit("-"), strings.slice_(v, 0, 2)), "CASE WHEN length(value) >= 2 THEN value || '-' || substr(value, 1, 2) END"),
        },
    ),
    "op_integers": _operators(
        ORDERS,
        _D,
        {
            "read": (integers.digits_to_integer, _n),
            "mod_digits": (lambda v: integers.mod_digits(v, 97), f"{_n} % 97"),
            "mod_digits_long": (lambda v: integers.mod_digits(F.concat(v, v), 97), f"CAST(({_n}::HUGEINT * CAST(pow(10, length(value)) AS HUGEINT) + {_n}) % 97 AS BIGINT)"),
            "sum_left": (lambda v: integers.weighted_sum(v, [3, 1, 4]), f"CASE WHEN {_dig} THEN {wsum('value', [3, 1, 4])} END"),
            "sum_right": (lambda v: integers.weighted_sum(v, [3, 1, 4], integers.RIGHT), f"CASE WHEN {_dig} THEN {wsum('right(value, 3)', [3, 1, 4])} END"),
            "sum_cycle": (lambda v: integers.weighted_sum(v, [3, 1], integers.CYCLE), f"CASE WHEN {_dig} THEN CAST(list_sum([CAST(substr(value, i, 1) AS BIGINT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END FOR i IN range(1, length(value) + 1)]) AS BIGINT) END"),
            "sum_base36": (lambda v: integers.base36_sum(F.concat(F.lit("Z"), v), [2, 1]), f"CASE WHEN value = '' THEN 70 WHEN {_dig} THEN 70 + CAST(substr(value, 1, 1) AS BIGINT) END"),
            "sum_alphabet": (lambda v: integers.weighted_sum(v, [1, 2, 3], alphabet="9876543210"), f"CASE WHEN {_dig} THEN 54 - {wsum('value', [1, 2, 3])} END"),
            "reduced": (lambda v: integers.modulo(integers.digits_to_integer(v) - 5_000_000, 97), f"((({_n} - 5000000) % 97) + 97) % 97"),
            "complement": (lambda v: integers.complement(integers.modulo(integers.digits_to_integer(v), 200), 97), f"CASE WHEN {_n} % 200 <= 97 THEN 97 - {_n} % 200 END"),
            "remainder": (lambda v: integers.remainder_map(integers.modulo(integers.digits_to_integer(v), 8), [5, 4, 3, 2, 1]), f"CASE WHEN {_n} % 8 < 5 THEN 5 - {_n} % 8 END"),
        },
    ),
    "op_predicates": _operators(
        ORDERS,
        _V,
        {
            "empty": (predicates.is_empty, "coalesce(value = '', false)"),
            "absent": (predicates.is_absent, "value IS NULL"),
            "equal": (lambda v: predicates.equals(v, strings.concat(F.lit("H"), strings.slice_from(v, 1))), "coalesce(starts_with(value, 'H'), false)"),
            "length_eq": (lambda v: predicates.length_eq(v, 7), "coalesce(length(value) = 7, false)"),
            "length_in": (lambda v: predicates.length_in(v, [0, 9]), "coalesce(length(value) IN (0, 9), false)"),
            "length_between": (lambda v: predicates.length_between(v, 1, 8), "coalesce(length(value) BETWEEN 1 AND 8, false)"),
            "all_digits": (lambda v: predicates.ascii_digits(strings.slice_from(v, 1)), "coalesce(length(value) > 1 AND NOT contains(value, '.'), false)"),
            "all_upper": (lambda v: predicates.ascii_upper_letters(strings.slice_(v, 0, 1)), "coalesce(value <> '', false)"),
            "alphanumeric": (predicates.ascii_alphanumeric, "coalesce(value <> '' AND NOT contains(value, '.'), false)"),
            "charset": (lambda v: predicates.ascii_charset(strings.after_first(v, "."), "xy"), "coalesce(contains(value, '.'), false)"),
            "starts": (lambda v: predicates.starts_with(v, "O"), "coalesce(starts_with(value, 'O'), false)"),
            "ends": (lambda v: predicates.ends_with(v, ".x"), "coalesce(ends_with(value, '.x'), false)"),
            "listed": (lambda v: predicates.prefix_in(v, ["A", "AA", "B1", "H0"]), "coalesce(starts_with(value, 'A') OR starts_with(value, 'B1') OR starts_with(value, 'H0'), false)"),
            "char_at": (lambda v: predicates.char_at_in(v, 7, ".-"), "coalesce(contains(value, '.'), false)"),
            "contained": (lambda v: predicates.contains(v, "00"), "coalesce(contains(value, '00'), false)"),
            "every": (lambda v: predicates.all_of(predicates.starts_with(v, "O"), predicates.length_eq(v, 7)), "coalesce(starts_with(value, 'O') AND length(value) = 7, false)"),
            "some": (lambda v: predicates.any_of(predicates.starts_with(v, "O"), predicates.is_absent(v)), "coalesce(starts_with(value, 'O'), true)"),
            "negated": (lambda v: predicates.not_(predicates.starts_with(v, "O")), "NOT coalesce(starts_with(value, 'O'), false)"),
            "profile": (lambda v: predicates.profile_is(F.when(v == "", "compatible"), "compatible"), "coalesce(value = '', false)"),
            "integer": (lambda v: predicates.integer_is(F.length(v), 9), "coalesce(length(value) = 9, false)"),
        },
    ),
    "op_canonicalization": _operators(
        CUSTOMER,
        "concat(CASE WHEN k % 3 = 0 THEN '  ' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'gr' ELSE 'GR' END, ' ', " + number(5) + ", '-', 'ß')",
        {
            "trimmed": (canonical.trim_whitespace(), "trim(value, '  ')"),
            "closed": (canonical.remove_whitespace(), "translate(value, '  ', '')"),
            "upper": (canonical.uppercase_ascii(), f"translate(value, {_LETTERS})"),
            "bare": (canonical.remove_chars("-ß0"), "translate(value, '-ß0', '')"),
            "replaced": (canonical.replace_prefix("GR", "EL"), "CASE WHEN starts_with(value, 'GR') THEN 'EL' || substr(value, 3) ELSE value END"),
            "prepended": (canonical.prepend("x"), "'x' || value"),
            "appended": (canonical.append("x"), "value || 'x'"),
            "inserted": (canonical.insert(11, "0"), "CASE WHEN length(value) >= 11 THEN substr(value, 1, 11) || '0' || substr(value, 12) ELSE value END"),
            "padded": (canonical.left_pad(12, "*"), "CASE WHEN length(value) < 12 THEN lpad(value, 12, '*') ELSE value END"),
            "with_country": (canonical.prepend_country_if_missing(["GR", "EL"], "EL"), "CASE WHEN starts_with(value, 'GR') THEN value ELSE 'EL' || value END"),
            "conditional": (canonical.when(lambda v: predicates.length_eq(v, 10), canonical.append("!")), "CASE WHEN length(value) = 10 THEN value || '!' ELSE value END"),
            "sequence": (canonical.steps(canonical.remove_whitespace(), canonical.uppercase_ascii(), canonical.remove_chars("-")), f"translate(translate(value, {_LETTERS}), '  -', '')"),
        },
    ),
    "op_assertions": _operators(
        ORDERS,
        _D,
        {
            "reason": (lambda v: assertions.sequence(assertions.require(~predicates.is_empty(v), "empty", "a"), assertions.require(predicates.length_eq(v, 12), "invalid_length", "b"), assertions.require(predicates.ascii_digits(v), "invalid_characters"))["reason_code"], f"CASE WHEN value = '' THEN 'empty' WHEN length(value) IS DISTINCT FROM 12 THEN 'invalid_length' WHEN NOT {_dig} THEN 'invalid_characters' END"),
            "message": (lambda v: assertions.call_format(lambda s: assertions.require(predicates.length_eq(s, 9), "invalid_length", "n"), strings.slice_from(v, 3))["message_key"], "CASE WHEN length(value) IS DISTINCT FROM 12 THEN 'n' END"),
        },
    ),
    "op_outcomes": _operators(
        ORDERS,
        _D,
        {
            "luhn": (_status(outcomes.luhn), f"CASE WHEN {_dig} AND length(value) > 1 THEN {verdict(luhn('value'))} ELSE 'unsupported|unsupported_checksum' END"),
            "mod97": (_status(outcomes.mod97_10), f"CASE WHEN {_dig} AND length(value) > 2 THEN {verdict(f'{_n} % 97 = 1')} ELSE 'unsupported|unsupported_checksum' END"),
            "digit": (_status(_cd), _sql_cd),
            "sliced": (_status(lambda v: outcomes.compare_slice(_mod11(v), v, 4, 6)), f"CASE WHEN {_n} IS NULL OR length(value) < 6 THEN 'unsupported|unsupported_checksum' WHEN {_sql_m} = {number_at('value', 5, 2)} THEN 'valid|ok' ELSE 'invalid|invalid_checksum' END"),
            "constant": (_status(_cc), _sql_cc),
            "chosen": (_status(lambda v: outcomes.choose(outcomes.when(predicates.starts_with(v, "1"), _cd(v)), outcomes.when(predicates.starts_with(v, "2"), _cc(v)))), f"CASE WHEN starts_with(value, '1') THEN {_sql_cd} WHEN starts_with(value, '2') THEN {_sql_cc} ELSE 'unsupported|unsupported_checksum' END"),
            "all_of": (_status(lambda v: outcomes.all_checks(_cd(v), _cc(v))), f"CASE WHEN starts_with({_sql_cd}, 'i') OR starts_with({_sql_cc}, 'i') THEN 'invalid|invalid_checksum' WHEN starts_with({_sql_cd}, 'u') OR starts_with({_sql_cc}, 'u') THEN 'unsupported|unsupported_checksum' ELSE 'valid|ok' END"),
            "any_of": (_status(lambda v: outcomes.any_check(_cd(v), _cc(v))), f"CASE WHEN starts_with({_sql_cd}, 'v') OR starts_with({_sql_cc}, 'v') THEN 'valid|ok' WHEN starts_with({_sql_cd}, 'u') OR starts_with({_sql_cc}, 'u') THEN 'unsupported|unsupported_checksum' ELSE 'invalid|invalid_checksum' END"),
            "none": (_status(lambda v: outcomes.unsupported("checksum_not_published")), "'unsupported|checksum_not_published'"),
            "called": (_status(lambda v: outcomes.call_checksum(_cc, strings.slice_from(v, 3))), f"CASE WHEN length(value) > 3 AND {digits('substr(value, 4)')} THEN {verdict('TRY_CAST(substr(value, 4) AS BIGINT) % 11 = 4')} ELSE 'unsupported|unsupported_checksum' END"),
        },
    ),
}

QUERIES: dict[str, Query] = {
    **{name: case.query for name, case in CASES.items()},
    **{name: query for name, (query, _) in (FAMILIES | OPERATORS).items()},
    "validate_euid_de": validate_euid_de,
    "capabilities": capabilities,
    "dispatch": dispatch,
    "format_only": format_only,
    "rules_info": rules_info,
    "verdict_summary": verdict_summary,
}
ORACLE: dict[str, str] = {
    **{name: case.sql() for name, case in CASES.items()},
    **{name: sql for name, (_, sql) in (FAMILIES | OPERATORS).items()},
    "validate_euid_de": _DE_CASE.sql(),
    "capabilities": "SELECT unnest([1, 2, 3, 4, 5, 10, 11, 20, 21, 30, 31, 32, 33, 34, 35, 40, 41, 42])::INTEGER AS capability",
    "dispatch": DISPATCH_SQL,
    "format_only": FORMAT_ONLY_SQL,
    "rules_info": RULES_INFO_SQL,
    "verdict_summary": _summary_sql(),
}
