"""Long texts made to slow patterns down: time grows with the length, and results are those of the contract."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract, pii

MODEL = html_extract.Model()
PAGES = {
    "unclosed tags": "<a " * 350_000, "only a quoted end": "<a " * 300_000 + 'b=">"', "spaces in a tag": "<a" + " " * 1_000_000 + ">x", "end tags of nothing": "<i>" * 100_000 + "</b>" * 100_000,
    "items under spans": "<ul>" + "<span>" * 100_000 + "<li>" * 100_000, "paragraphs under spans": "<p><div>" + "<span>" * 60_000 + "<p>x</p>" * 60_000, "brackets": "<" * 500_000, "blocks in a drawing": "<svg>" + "<g>" * 50_000 + "<p>" * 50_000,
    "unclosed values": '<a ="' * 200_000, "unclosed scripts": "<script " * 100_000, "names of attributes": "<a class" + " class " * 100_000 + ">",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_take_linear_time(name):
    began = time.process_time()
    html_extract.extract(PAGES[name], MODEL)
    assert time.process_time() - began < 4


def test_what_follows_an_unclosed_tag():
    assert html_extract.extract("<p>One</p><p>Two</p> 1 < 2 <a href", MODEL) == "One\nTwo\n1 < 2 <a href"


TEXTS = {
    "a word and an address": ("a" * 1_000_000 + " x@y.zz", ["email:1000001:1000007"]), "digits": ("1" * 1_000_000, []), "dots": ("1." * 300_000, None), "ats": ("a@" * 300_000, []), "pluses": ("+1(" * 300_000, []),
    "many addresses": ("ab@c.de " * 40_000, [f"email:{i}:{i + 7}" for i in range(0, 320_000, 8)]), "blanks": ("1 " + " " * 500_000 + "2", []),
}


@pytest.mark.parametrize("name", TEXTS)
def test_base_spans_take_linear_time(spark, name):
    text, want = TEXTS[name]
    df = pii.spans(spark.createDataFrame([(1, "warm up a@b.cc")], "doc_id long, text string"))
    df.collect()
    began = time.time()
    row = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(*pii.KINDS).first()
    assert time.time() - began < 12  # a second or two of it for the session's own work
    if want is not None:
        assert [f"{k}:{s['start']}:{s['end']}" for k in pii.KINDS for s in row[k]] == want


def test_base_spans_equal_the_patterns(spark):
    """The contract's patterns by another engine, on short texts of the characters that matter."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("a_b@@..-1 é") for _ in range(rng.randint(1, 60))) for _ in range(1_500)] + ["a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x 1.2.3.256 1.2.3.4", "a@b.-.c@d.e.f"]
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("text", F.transform("email", lambda x: x["s"]), F.transform("ip", lambda x: x["s"]), "email").collect()
    for text, emails, ips, placed in got:
        assert emails == [m[0] for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)], text
        assert ips == [m[0] for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))], text
        assert all(text[s["start"] : s["end"]] == s["s"] for s in placed)
