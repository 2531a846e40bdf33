"""Small inputs written for the patterns that the tables do not hold."""

from .registry import table

MENTIONS = [
    (1, "Acme Widgets, Inc.", "PARTY", "a.txt"),
    (2, "ACME WIDGETS INC", "PARTY", "b.txt"),
    (3, "Acme Widgets", "PARTY", "a.txt"),
    (4, "Beta Distribution, LLC", "PARTY", "a.txt"),
    (5, "Beta Distributions Ltd.", "PARTY", "b.txt"),
    (6, "IBQ", "PARTY", "a.txt"),
    (7, "ib", "PARTY", "a.txt"),
    (8, "Supply Agreement 2019", "CONTRACT", "a.txt"),
    (9, "Supply Agreement 2021", "CONTRACT", "b.txt"),
    (10, "supply  agreement", "CONTRACT", "b.txt"),
    (11, "March 4, 2019", "EFFECTIVE_DATE", "a.txt"),
    (12, "Mar. 4, 2019", "EFFECTIVE_DATE", "b.txt"),
    (13, "3/4/2019", "DATE", "b.txt"),
    (14, "State of Delaware", "JURISDICTION", "a.txt"),
    (15, "new york", "JURISDICTION", "b.txt"),
    (16, "the party hereto shall at all times and in all places pay", "PARTY", "b.txt"),
    (17, "pursuant to section 15", "PARTY", "a.txt"),
    (18, "x ***", "PARTY", "a.txt"),
    (19, "42", "PARTY", "a.txt"),
    (20, "2 affiliate 1 2", "PARTY", "a.txt"),
    (21, "this", "PARTY", "a.txt"),
    (22, "Gamma, Delta, and Sons", "PARTY", "b.txt"),
    (23, "--", "PARTY", "b.txt"),
    (24, "", "PARTY", "b.txt"),
    (25, "Omega Holdings Co., Inc.", "PARTY", "b.txt"),
    (26, "the company", "PARTY", "b.txt"),
    (27, "Master Services Order", "PARTY", "c.txt"),
    (28, "Widget Makers of Texas", "PARTY", "c.txt"),
]

PREDICATES = [
    (1, "entered into"), (2, "shall be governed by the laws"), (3, "is a party to"), (4, "Dated as of"), (5, "hereinafter referred to as"),
    (6, "promises"), (7, "jumped over"), (8, ") , ( 3"), (9, "incorporated in"), (10, "shall not exceed"), (11, "held"), (12, "  "),
    (13, "requested with"), (14, "12ab"), (15, "grants to"),
]

SENTENCES = [
    (1, "This Supply Agreement is effective as of March 4, 2019 between Acme Widgets and Beta.", "Supply Agreement"),
    (2, "Acme Widgets is a company organized under the laws of Delaware, with offices in Ohio.", "Acme Widgets"),
    (3, "The License was signed on 3/4/19 by Beta.", "Beta"),
    (4, "Nothing of note happens here at all.", "Gamma"),
    (5, "Any order by Gamma is void.", "Gamma"),
    (6, "Gamma is seated in new york today.", "Gamma"),
]

DOCUMENTS = [
    ("Acme_Supply Agreement.txt", "SUPPLY AGREEMENT\nThis Supply Agreement is made effective as of March 4, 2019 by and between Acme Widgets Inc. and Beta Distribution LLC. It is governed by the laws of the State of Delaware, without regard to conflicts. Acme Widgets Inc. is located in Texas, at its offices.\nPage 3 of 9\n12\nThey agree."),
    ("Copy of it.txt", "SUPPLY AGREEMENT\nThis Supply Agreement is made effective as of March 4, 2019 by and between Acme Widgets Inc. and Beta Distribution LLC. It is governed by the laws of the State of Delaware, without regard to conflicts. Acme Widgets Inc. is located in Texas, at its offices.\nPage 3 of 9\n12\nThey agree."),
    ("Gamma License.txt", "GAMMA SOFTWARE LICENSE\nGamma Software Corp. grants to Delta Systems Ltd. a license dated as of January 15, 2020. The parties meet in Ohio. It is seated in Ohio."),
    ("empty.txt", ""),
]


def with_documents(spark, sf_dir):
    """(doc_id, text) of the whole documents table and of DOCUMENTS."""
    own = spark.createDataFrame(DOCUMENTS, "doc_id string, text string")
    return table(spark, sf_dir, "documents").selectExpr("string(doc_id) AS doc_id", "text").union(own)
