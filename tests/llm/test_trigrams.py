"""Every text that a rule's pattern matches is a candidate by the trigram query derived from the pattern."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seedlake.llm import secrets

PATTERNS = [r.pattern for r in secrets.BASE + secrets.MORE] + [r"(?:ab|c)d+e?fgh", r"(abc){2}x*", r"a{3}[xyz]b", r"(?:foo|bar[0-9])baz", r"[a-z]+", r"ab(?:cd)?ef", r"^key\b-(?:one|two|three)$"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_are_candidates(pattern):
    query = secrets.query_of(pattern)

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.from_regex(pattern))
    def held(text):
        folded = text.translate(secrets.FOLD)
        assert not query or any(all(g in folded for g in need) for need in query)

    held()


def test_queries():
    assert secrets.query_of("[0-9a-f]+") == () and secrets.query_of("ab") == () and secrets.query_of("(?i)secret") == ()
    assert secrets.query_of("AKIA[A-Z0-9]+") == (("aki", "kia"),)
    kinds = {k for k, _, _ in secrets.queries_of(secrets.BASE + secrets.MORE)}
    assert kinds == {r.kind for r in secrets.BASE + secrets.MORE} - {"hex"}
    assert len([1 for k, _, _ in secrets.queries_of(secrets.BASE) if k == "assign"]) == 6
