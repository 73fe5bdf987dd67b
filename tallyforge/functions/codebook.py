"""The nature-of-suit codebook: 93 codes in 13 families."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

RULE_VERSION = "1"
CODEBOOK_DATE = date(2023, 10, 25)

#: Code, label and family (fixed values).
CODES = [
    ("110", "Insurance", "contract"),
    ("120", "Marine Contract Actions", "contract"),
    ("130", "Miller Act", "contract"),
    ("140", "Negotiable Instruments", "contract"),
    ("150", "Overpayments and Enforcement of Judgments", "contract"),
    ("151", "Overpayments under the Medicare Act", "contract"),
    ("152", "Recovery of Defaulted Student Loans", "contract"),
    ("153", "Recovery of Overpayments of Veteran Benefits", "contract"),
    ("160", "Stockholder Suits", "contract"),
    ("190", "Other Contract Actions", "contract"),
    ("195", "Contract Product Liability", "contract"),
    ("196", "Franchise", "contract"),
    ("210", "Land Condemnation", "real_property"),
    ("220", "Foreclosure", "real_property"),
    ("230", "Rent, Lease, Ejectment", "real_property"),
    ("240", "Torts to Land", "real_property"),
    ("245", "Real Property Product Liability", "real_property"),
    ("290", "Other Real Property Actions", "real_property"),
    ("310", "Airplane Personal Injury", "tort_personal_injury"),
    ("315", "Airplane Product Liability", "tort_personal_injury"),
    ("320", "Assault, Libel, and Slander", "tort_personal_injury"),
    ("330", "Federal Employers Liability", "tort_personal_injury"),
    ("340", "Marine Personal Injury", "tort_personal_injury"),
    ("345", "Marine Product Liability", "tort_personal_injury"),
    ("350", "Motor Vehicle Personal Injury", "tort_personal_injury"),
    ("355", "Motor Vehicle Product Liability", "tort_personal_injury"),
    ("360", "Other Personal Injury", "tort_personal_injury"),
    ("362", "Medical Malpractice", "tort_personal_injury"),
    ("365", "Personal Injury Product Liability", "tort_personal_injury"),
    ("367", "Health Care and Pharmaceutical", "tort_personal_injury"),
    ("368", "Asbestos Personal Injury Product Liability", "tort_personal_injury"),
    ("370", "Other Fraud", "tort_personal_property"),
    ("371", "Truth in Lending", "tort_personal_property"),
    ("375", "False Claims Act", "tort_personal_property"),
    ("376", "Qui Tam False Claims Act", "tort_personal_property"),
    ("380", "Other Personal Property Damage", "tort_personal_property"),
    ("385", "Property Damage Product Liability", "tort_personal_property"),
    ("400", "State Reapportionment", "other_statute"),
    ("410", "Antitrust", "other_statute"),
    ("422", "Bankruptcy Appeals under 28 USC 158", "other_statute"),
    ("423", "Bankruptcy Withdrawal under 28 USC 157", "other_statute"),
    ("430", "Banks and Banking", "other_statute"),
    ("440", "Other Civil Rights", "civil_rights"),
    ("441", "Civil Rights Voting", "civil_rights"),
    ("442", "Civil Rights Employment", "civil_rights"),
    ("443", "Civil Rights Accommodations", "civil_rights"),
    ("445", "Americans with Disabilities Act Employment", "civil_rights"),
    ("446", "Americans with Disabilities Act Other", "civil_rights"),
    ("448", "Education", "civil_rights"),
    ("450", "Interstate Commerce", "other_statute"),
    ("460", "Deportation", "immigration"),
    ("462", "Naturalization Petition for Hearing of Denial", "immigration"),
    ("463", "Habeas Corpus Alien Detainee", "immigration"),
    ("465", "Other Immigration Actions", "immigration"),
    ("470", "Civil RICO", "other_statute"),
    ("480", "Consumer Credit", "other_statute"),
    ("485", "Telephone Consumer Protection Act", "other_statute"),
    ("490", "Cable and Satellite TV", "other_statute"),
    ("510", "Prisoner Petitions Vacate Sentence", "prisoner_petition"),
    ("530", "Prisoner Petitions Habeas Corpus", "prisoner_petition"),
    ("535", "Habeas Corpus Death Penalty", "prisoner_petition"),
    ("540", "Prisoner Petitions Mandamus and Other", "prisoner_petition"),
    ("550", "Prisoner Civil Rights", "prisoner_petition"),
    ("555", "Prisoner Prison Condition", "prisoner_petition"),
    ("560", "Civil Detainee", "prisoner_petition"),
    ("625", "Drug Related Seizure of Property", "forfeiture_penalty"),
    ("690", "Other Forfeiture and Penalty Suits", "forfeiture_penalty"),
    ("710", "Fair Labor Standards Act", "labor"),
    ("720", "Labor Management Relations Act", "labor"),
    ("740", "Railway Labor Act", "labor"),
    ("751", "Family and Medical Leave Act", "labor"),
    ("790", "Other Labor Litigation", "labor"),
    ("791", "Employee Retirement Income Security Act", "labor"),
    ("820", "Copyright", "property_rights"),
    ("830", "Patent", "property_rights"),
    ("835", "Patent Abbreviated New Drug Application", "property_rights"),
    ("840", "Trademark", "property_rights"),
    ("850", "Securities, Commodities, Exchange", "other_statute"),
    ("861", "Social Security HIA", "social_security"),
    ("862", "Social Security Black Lung", "social_security"),
    ("863", "Social Security DIWC and DIWW", "social_security"),
    ("864", "Social Security SSID Title XVI", "social_security"),
    ("865", "Social Security RSI", "social_security"),
    ("870", "Tax Suits", "federal_tax"),
    ("871", "IRS Third Party Suits", "federal_tax"),
    ("880", "Defend Trade Secrets Act", "other_statute"),
    ("890", "Other Statutory Actions", "other_statute"),
    ("891", "Agricultural Acts", "other_statute"),
    ("893", "Environmental Matters", "other_statute"),
    ("895", "Freedom of Information Act", "other_statute"),
    ("896", "Arbitration", "other_statute"),
    ("899", "Administrative Procedure Act Review or Appeal", "other_statute"),
    ("950", "Constitutionality of State Statutes", "other_statute"),
]
FAMILIES: dict[str, list[str]] = {}
for _code, _, _family in CODES:
    FAMILIES.setdefault(_family, []).append(_code)


def codebook(spark: SparkSession) -> DataFrame:
    """(raw_code, canonical_code, label, family, codebook_as_of_date, rule_version); 93 rows, so a join may broadcast it."""
    rows = [(code, code, label, family, CODEBOOK_DATE, RULE_VERSION) for code, label, family in CODES]
    schema = "raw_code string, canonical_code string, label string, family string, codebook_as_of_date date, rule_version string"
    return spark.createDataFrame(rows, schema)
