"""Arrays cut into elements: small bodies, and bodies in blocks, against a parser that goes from left to right."""

import json
import random

import numpy as np
import pytest

from rolegrid.sources import arrays, feed

SPACE = " \t\n\r"


def plain(body):
    """Elements as written by the json module's own scanner, None for anything but an array."""
    text = (body or "").strip(SPACE)
    if not text.startswith("["):
        return None

    def refuse(name):
        raise ValueError(name)

    decoder, at, out = json.JSONDecoder(parse_constant=refuse), 1, []
    skip = lambda k: k + len(text[k:]) - len(text[k:].lstrip(SPACE))
    try:
        at = skip(at)
        if text[at:] == "]":
            return []
        while True:
            _, end = decoder.raw_decode(text, at)
            out.append(text[at:end])
            at = skip(end)
            if text[at:] == "]":
                return out
            if text[at : at + 1] != ",":
                return None
            at = skip(at + 1)
    except ValueError:
        return None


BITS = ['"a"', r'"\""', r'"\\"', r'"\\\""', r'"[,]{"', "1", "-2.5e3", "null", "true", '{"k":[1,{"x":"],"}]}', "[[],[]]", '"é€𝔘"', "{}", " 7 ", '"' + "\\\\" * 5 + '"', '{"a" : "b,\\"c" }']
BREAKS = [("]", "}"), ("{", "["), ('"', ""), (",", ",,"), ("[", ""), ("\\", ""), ("1", "NaN"), ("}", "]"), ("null", "nul")]


def bodies(seed, n):
    rng = random.Random(seed)
    out = [None, "", "null", "[]", " [ ] ", "[,]", "[1,]", "[", "]", "[]]", "[1],[2]", "{}", '["open]', r'["a" \", "b"]', '["\\"]', "[1 2]", "[" + "\\" * 9 + "]", '["' + "\\" * 40 + '"]', "﻿[1]", "[1]x"]
    for _ in range(n):
        text = "[" + ",".join(rng.choice(BITS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12))) + "]"
        if rng.random() < 0.4:
            a, b = rng.choice(BREAKS)
            at = rng.randrange(len(text))
            text = text[:at] + text[at:].replace(a, b, 1)
        out.append(rng.choice(["", " ", "\n"]) + text)
    return out


@pytest.mark.parametrize("block", [1, 5, 16, 1 << 20])
def test_elements_as_a_parser_finds_them(spark, block):
    texts = bodies(block, 120)
    rows = spark.createDataFrame([(k, "x", t) for k, t in enumerate(texts)], "id bigint, idx_ string, body string").repartition(4)
    elements, rest = arrays.split_arrays(rows, "body", block)
    got = {}
    for r in elements.collect():
        got.setdefault(r["id"], []).append((r["idx"], r["element"]))
    refused = {r["id"]: r["body"] for r in rest.collect()}
    for k, t in enumerate(texts):
        want = plain(t)
        if want is None:
            assert k not in got and refused[k] == t, t
        else:
            assert sorted(got.get(k, [])) == list(enumerate(want)) and k not in refused, t


def test_one_large_body_spreads_over_tasks(spark):
    body = "[" + ",".join('{"id":%d,"t":"%s"}' % (k, "x" * (k % 50)) for k in range(20_000)) + "]"
    elements, rejects = feed.scan_feed(spark.createDataFrame([("a", body), ("b", "[1]")], "source string, body string"), block=10_000)
    rows = elements.collect()
    assert len(rows) == 20_001 and rejects.count() == 0
    large = sorted((r["idx"], r["element"]) for r in rows if r["source"] == "a")
    assert [x for _, x in large] == plain(body)
    deep = "[" * 60_000 + "]" * 60_000
    crossed = "[" * 60_000 + "}" + "]" * 60_000
    elements, rejects = feed.scan_feed(spark.createDataFrame([("d", f"[{deep}, 1]"), ("c", f"[{crossed}, 1]")], "source string, body string"), block=10_000)
    assert [(r["source"], len(r["element"])) for r in elements.orderBy("idx").collect()] == [("d", 120_000), ("d", 1)]
    assert [r["source"] for r in rejects.collect()] == ["c"]


def test_transitions_combine_associatively(rng=random.Random(3)):
    tools = arrays._Tools()

    def moves(data):
        out = []
        for in_string in (False, True):
            for escaped in (False, True):
                _, _, depth, end = tools.scan(data, np.zeros(1, np.int64), in_string, escaped)
                out += [2 * end[0] + end[1], int(depth[-1])]
        return out

    for _ in range(300):
        a, b, c = (bytes(rng.choice(b'\\\\"[]{},a') for _ in range(rng.randrange(1, 9))) for _ in range(3))
        assert tools.then(moves(a), moves(b)) == moves(a + b)
        assert tools.then(tools.then(moves(a), moves(b)), moves(c)) == tools.then(moves(a), tools.then(moves(b), moves(c))) == moves(a + b + c)
