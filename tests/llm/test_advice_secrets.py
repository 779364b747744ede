"""op4's candidates: short, odd and digit-free secrets reach the forest."""

import pytest

from gridloom.llm import secrets


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password = "Tr0ub4dor&3"', "Tr0ub4dor&3"), ("DB_PASSWD: p@$$w0rd!", "p@$$w0rd!"), ("'api_key': 'qwRtzUiOp'", "qwRtzUiOp"), ('passphrase="correct horse battery staple"', "correct horse battery staple"),
        ("?token=abc!defg&user=me", "abc!defg"), ("Authorization: Bearer aB.cd-efgh", "aB.cd-efgh"), ("see QwErTyUiOpAsDfGhJkLz here", "QwErTyUiOpAsDfGhJkLz"),
        ("-----BEGIN RSA PRIVATE KEY-----\nMIIE", "-----BEGIN RSA PRIVATE KEY-----"), ("x ab12cd34ef56ab78cd90 y", "ab12cd34ef56ab78cd90"),
    ],
)
def test_places(text, want):
    assert want in [text[s:e] for s, e in secrets.places(text)]


def test_rows(spark):
    rows = [(1, 'password = "Tr0ub4dor&3"'), (2, "-----BEGIN PRIVATE KEY-----"), (3, "plain words alone: none here"), (4, None)]
    got = {r["doc_id"] for r in secrets.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 2}
    assert len(secrets.places("key=" * 50_000)) < 3
