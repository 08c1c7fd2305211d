"""A proposal inside of a base span never counts, however many spans stand between."""

from noticelake.llm import pii


def test_many_short_spans_in_a_long_one():
    inner = ".".join(f"10.0.0.{i}" for i in range(0, 48, 4)) + "_ssn_078-05-1120"
    text = f"social security {inner}@example.org"
    spans = pii.find_spans(text)
    email = next(s for s in spans if s[0] == "email")
    assert (email[1], email[2]) == (16, len(text)) and sum(s[0] == "ip" for s in spans) >= 9
    assert all(s[4] for s in spans)
    assert any(s[0] == "ssn" for s in pii.find_spans("social security number 078-05-1120"))
