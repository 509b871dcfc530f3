"""Long runs of keywords take time in proportion to the text."""

import time

from tessera.llm import secrets

TOKEN = b"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc-_1"


def test_failed_tokens_are_passed_over():
    began = time.perf_counter()
    for text in (b"eyJ" * 300_000, b"eyJ." * 200_000, b"token" * 200_000, b"-----BEGIN " * 100_000, b"AKIA" * 200_000):
        assert all(k in ("assign", "access", "hex") for *_, k in secrets.spans(text))
    assert time.perf_counter() - began < 20


def test_a_token_after_a_failed_one_is_found():
    for lead in (b"eyJx.", b"eyJeyJ ", b"eyJa.eyJb.c "):
        assert [(a, b) for a, b, k in secrets.spans(lead + TOKEN) if k == "jwt"] == [(len(lead), len(lead) + len(TOKEN))]
