"""Registered laws and domains: which series belong together, and how each enters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Members of the laws, in order.
LAWS = {
    "phillips": ["CPILFESL", "UNRATE", "CES0500000003", "MICH", "T5YIE"],
    "okun": ["UNRATE", "GDPC1", "INDPRO", "ICSA", "TCU"],
    "solow": ["GDPC1", "PAYEMS", "OPHNFB", "TCU", "NCBDBIQ027S"],
}
# Series that add up within a month; others are averaged.
SUMMED = ["ICSA"]
# Members of the domains.
DOMAINS = {
    "real_activity": "GDPC1 GDPDEF GDPPOT INDPRO IPMAN CMRMTSPL TCU ISRATIO CFNAI CFNAIMA3 NEWORDER DGORDER ACDGNO HOUST PERMIT HSN1F CSUSHPINSA SPCS20RSA RSXFS EXHOSLUSM495S OPHNFB",
    "labor": "UNRATE NROU PAYEMS CIVPART AWHAETP CES0500000003 ICSA CCSA JTSJOL JTSQUR SAHMREALTIME RECPROUSM156N",
    "inflation": "CPIAUCSL CPILFESL PCEPI PCEPILFE PCETRIM12M159SFRBDAL MEDCPIM158SFRBCLE TRMMEANCPIM158SFRBCLE PPIFIS CPALTT01USM657N MICH T5YIE T10YIE DCOILWTICO DCOILBRENTEU DHHNGSP",
    "monetary_rates": "FEDFUNDS DFF DPRIME MPRIME DGS1 DGS2 DGS3 DGS5 DGS7 DGS10 DGS20 DGS30 DTB3 DTB6 DFII5 DFII10 DFII20 DFII30 DAAA DBAA AAA10Y BAA10Y M1SL M2SL MZMSL BOGMBASE T10Y2Y T10Y3M T10YFF T5YFF TEDRATE",
    "credit_financial": "BAMLC0A0CM BAMLC0A1CAAA BAMLC0A4CBBB BAMLH0A0HYM2 BAMLH0A1HYBB BAMLH0A2HYB BAMLH0A3HYC ANFCI NFCI STLFSI2 MORTGAGE15US MORTGAGE30US BUSLOANS TOTCI TOTLL REALLN CDSP TDSP MDSP DRALACBS DRCCLACBS DRCLACBS CORALACBS CORCACBS CORCCACBS",
    "sentiment": "UMCSENT CSCICP03USM665S CONSUMER",
    "external": "DEXCAUS DEXJPUS DEXSZUS DEXUSAL DEXUSEU DEXUSUK DTWEXAFEGS DTWEXBGS DTWEXEMEGS BOPGSTB IEABC",
    "capital": "NCBDBIQ027S BCNSDODNS",
}
# Series that enter as log changes.
LOG_CHANGES = (
    "GDPC1 GDPDEF GDPPOT INDPRO IPMAN CMRMTSPL NEWORDER DGORDER ACDGNO HOUST PERMIT HSN1F CSUSHPINSA SPCS20RSA RSXFS EXHOSLUSM495S OPHNFB PAYEMS CES0500000003 ICSA CCSA JTSJOL "
    "CPIAUCSL CPILFESL PCEPI PCEPILFE PPIFIS DCOILWTICO DCOILBRENTEU DHHNGSP M1SL M2SL MZMSL BOGMBASE M2V_DERIVED BUSLOANS TOTCI TOTLL REALLN NCBDBIQ027S BCNSDODNS"
).split()


def laws(spark: SparkSession) -> DataFrame:
    """law, place, series_id, how: one row for each member of a law."""
    rows = [(law, k + 1, s, "sum" if s in SUMMED else "mean") for law, members in LAWS.items() for k, s in enumerate(members)]
    return spark.createDataFrame(rows, "law string, place int, series_id string, how string")


def domains(spark: SparkSession) -> DataFrame:
    """domain, series_id, log_change: one row for each member of a domain."""
    rows = [(domain, s, s in LOG_CHANGES) for domain, members in DOMAINS.items() for s in members.split()]
    return spark.createDataFrame(rows, "domain string, series_id string, log_change boolean")


def laws_sql() -> str:
    lists = " union all ".join(f"select '{law}' as law, {members!r} as m" for law, members in LAWS.items())
    return f"select law, generate_subscripts(m, 1)::int as place, unnest(m) as series_id, case when unnest(m) in {tuple(SUMMED + [''])!r} then 'sum' else 'mean' end as how from ({lists})"


def domains_sql() -> str:
    lists = " union all ".join(f"select '{domain}' as domain, string_split('{members}', ' ') as m" for domain, members in DOMAINS.items())
    return f"select domain, s as series_id, list_contains({LOG_CHANGES!r}, s) as log_change from (select domain, unnest(m) as s from ({lists}))"
