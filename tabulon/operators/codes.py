"""Code dictionaries and text signals of extract records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.text import squeeze

#: Labels of funding categories, applicants, instruments and kinds of opportunities, and the discipline of a category.
CATEGORIES = {
    "ACA": "Affordable Care Act", "AG": "Agriculture", "AR": "Arts", "BC": "Business and Commerce", "CD": "Community Development", "CP": "Consumer Protection", "DPR": "Disaster Prevention and Relief", "ED": "Education",
    "ELT": "Employment, Labor and Training", "EN": "Energy", "ENV": "Environment", "FN": "Food and Nutrition", "HL": "Health", "HO": "Housing", "HU": "Humanities", "ISS": "Income Security and Social Services",
    "IS": "Information and Statistics", "LJL": "Law, Justice and Legal Services", "NR": "Natural Resources", "O": "Other", "OZ": "Opportunity Zone Benefits", "RA": "Recovery Act", "RD": "Regional Development",
    "ST": "Science and Technology and other Research and Development", "T": "Transportation",
}
APPLICANTS = {
    "00": "State governments", "01": "County governments", "02": "City or township governments", "04": "Special district governments", "05": "Independent school districts", "06": "Public and state institutions of higher education",
    "07": "Federally recognized Native American tribal governments", "08": "Public and Indian housing authorities", "11": "Other Native American tribal organizations", "12": "Nonprofits with 501(c)(3) status", "13": "Nonprofits without 501(c)(3) status",
    "20": "Private institutions of higher education", "21": "Individuals", "22": "For-profit organizations other than small businesses", "23": "Small businesses", "25": "Other", "99": "Unrestricted",
}
INSTRUMENTS = {"CA": "Cooperative Agreement", "G": "Grant", "PC": "Procurement Contract", "O": "Other"}
KINDS = {"D": "Discretionary", "M": "Mandatory", "C": "Continuation", "E": "Earmark", "O": "Other"}
DISCIPLINES = {
    "ACA": "Medical and Health", "AG": "Environmental and Life Sciences", "AR": "Arts and Humanities", "BC": "Business and Economic Development", "CD": "Community and Social Sciences", "CP": "Community and Social Sciences",
    "DPR": "Community and Social Sciences", "ED": "Education", "ELT": "Community and Social Sciences", "EN": "Engineering and Physical Sciences", "ENV": "Environmental and Life Sciences", "FN": "Environmental and Life Sciences",
    "HL": "Medical and Health", "HO": "Community and Social Sciences", "HU": "Arts and Humanities", "ISS": "Community and Social Sciences", "IS": "Engineering and Physical Sciences", "LJL": "Community and Social Sciences",
    "NR": "Environmental and Life Sciences", "OZ": "Business and Economic Development", "RD": "Business and Economic Development", "ST": "Engineering and Physical Sciences", "T": "Engineering and Physical Sciences",
}
#: Patterns of signals in a record's texts.
PRELIMINARY = r"(?i)\b(concept\s+paper|pre[\s-]?proposal|pre[\s-]?application|preliminary\s+proposal|letter\s+of\s+intent|LOI|white\s+paper)\b"
LIMITED = r"(?i)(?:limit(?:ed|s)?\s+(?:to\s+)?(?:one|two|three|1|2|3)\s+(?:application|proposal|submission)|(?:one|two|three|1|2|3)\s+(?:application|proposal|submission)s?.{0,120}per\s+(?:institution|organization|applicant|university))"
ROLLING = r"(?i)(?:\bopen\s+until\s+superseded\b|\bon\s+(?:an?\s+)?rolling\s+basis\b|\brolling\s+(?:deadline|application|applications|submission|submissions|acceptance|review)\b|\b(?:application|applications|proposal|proposals|submission|submissions)\s+(?:are\s+|will\s+be\s+)?(?:accepted|received|reviewed)\s+(?:on\s+)?(?:an?\s+)?rolling\b)"
EARLY_CAREER = r"(?i)\b(early[\s-]?career|new investigator|young investigator|junior faculty|postdoctoral|predoctoral|untenured|assistant professor)\b"


def unique(codes: Column) -> Column:
    return F.array_distinct(F.coalesce(codes, F.array().cast("array<string>")))


def _named(labels: dict[str, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code)


def categories(codes: Column) -> Column:
    return F.transform(unique(codes), lambda c: F.coalesce(_named(CATEGORIES, c), c))


def applicants(codes: Column) -> Column:
    """Labels; a code without one shows as such."""
    return F.transform(unique(codes), lambda c: F.coalesce(_named(APPLICANTS, c), F.concat(F.lit("Eligibility code "), c)))


def instruments(codes: Column) -> Column:
    return F.transform(unique(codes), lambda c: F.coalesce(_named(INSTRUMENTS, c), c))


def disciplines(codes: Column) -> Column:
    """Disciplines of the categories that have one, each once."""
    return F.array_distinct(F.filter(F.transform(unique(codes), lambda c: _named(DISCIPLINES, c)), lambda d: d.isNotNull()))


def opportunity_kind(code: Column) -> Column:
    return F.coalesce(_named(KINDS, code), code)


def first_match(pattern: str, text: Column, group: int = 0) -> Column:
    """First match in single blanks, or null."""
    return F.nullif(squeeze(F.regexp_extract(text, pattern, group)), F.lit(""))


def signals(text: Column) -> Column:
    """struct<preliminary, limited, rolling, early_career>: the first mention of an early stage or career, and whether submissions are limited or rolling."""
    text = F.coalesce(text, F.lit(""))
    stage, career = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (PRELIMINARY, EARLY_CAREER))
    return F.struct(stage.alias("preliminary"), text.rlike(LIMITED).alias("limited"), text.rlike(ROLLING).alias("rolling"), career.alias("early_career"))


def preliminary_kind(text: Column) -> Column:
    """Kind of the early stage that a text mentions first."""
    found = F.replace(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), PRELIMINARY, 1)), F.lit("-"), F.lit(" "))
    return (
        F.when(found == "", "preliminary")
        .when(found.isin("letter of intent", "loi"), "letter_of_intent")
        .when(F.contains(found, F.lit("concept")), "concept_paper")
        .when(F.contains(found, F.lit("white")), "white_paper")
        .when(F.contains(found, F.lit("application")), "preapplication")
        .otherwise("preproposal")
    )
