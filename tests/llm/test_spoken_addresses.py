"""Spoken addresses end in any label; plain prose has none."""

import pytest

from tallyhouse.llm import pii


@pytest.mark.parametrize("last", ["gr", "hu", "ro", "tr", "kr", "za", "xyz", "cloud", "com"])
@pytest.mark.parametrize("host", ["mail dot acme dot", "acme dot", "mail punkt acme punkt"])
def test_spoken_address(host, last):
    text = f"jane at {host} {last}"
    assert pii.find(f"to {text}, please")[1]["email"] == [(3, 3 + len(text))]


@pytest.mark.parametrize(
    "text", ["we stood at this point on the map", "look at the dot of ink", "he came at some point after noon"]
)
def test_prose(text):
    assert pii.find(text)[1]["email"] == []
