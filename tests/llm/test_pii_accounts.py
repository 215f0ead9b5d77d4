"""Account numbers beside other capitals and digits."""

from jostle.llm import pii


def test_iban_followed_by_capitals_or_digits(spark):
    number = "DE89 3704 0044 0532 0130 00"
    cases = [
        (number, f"IBAN {number} BIC COBADEFFXXX"), (number.replace(" ", ""), f"IBAN {number.replace(' ', '')} BIC COBADEFFXXX"),
        (number, f"IBAN {number} EUR 250"), (number.replace(" ", ""), f"{number.replace(' ', '')} 2024 thanks"),
        ("GB82 WEST 1234 5698 7654 32", "account GB82 WEST 1234 5698 7654 32 A1"), ("NO9386011117947", "konto NO9386011117947 NOK 5"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)] + [(99, f"{number} {cases[4][0]}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for k, (own, text) in enumerate(cases):
        assert got[k] == text.replace(own, "<IBAN>")
    assert got[99] == "<IBAN> <IBAN>"
