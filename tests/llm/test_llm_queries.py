"""Registered queries without SQL, and the pipeline, against plain versions over the whole smallest tables."""

import base64
import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomdex.llm.queries import ENTRIES  # noqa: E402
from test_llm_tables import plain_components, plain_statistics  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def rows(spark, name):
    return ENTRIES[name].run(spark, SF).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def word_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_pieces(pieces, texts, tokenizer):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = word_ids(tokenizer, text), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert 2048 * len(by_sequence) - total <= 2048 * 10  # a window per task at most is not full


def test_every_operator_has_one_query():
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in ENTRIES) != 1] == []


def test_quality_statistics(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op5_robust_quality")}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = plain_statistics(docs[i].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
        assert r.base_failed == (n_words < 20 or 100 * n_repeat > 30 * n_words)
        assert not (r.base_failed and r.kept)


def test_clean_labels_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = ENTRIES["op5_robust_quality"].run(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    judged = [r for r in got if not r.base_failed]
    assert all(r.kept for r in judged if r.quality == 1)
    bad = [r for r in judged if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) > 0


def test_surrogates_leave_no_original(spark, docs):
    private = re.compile(r"[\w.]+@[\w.]+\w|\d{1,3}(?:\.\d{1,3}){3}|\+1 \(\d{3}\) \d{3}-\d{4}|\d{16}|[0-9a-fA-F]{40}|AKIA[A-Z0-9]{16}|(?<=password=)\w+")
    got = rows(spark, "op7_surrogates")
    every = {v for d in docs.values() for v in private.findall(d.text or "")}
    made = collections.defaultdict(set)
    for r in got:
        before = private.findall(docs[r.doc_id].text or "")
        after = private.findall(r.text or "")
        assert len(before) == len(after) and not every & set(after)
        assert (r.n_replaced == 0) == (r.text == docs[r.doc_id].text) and r.n_replaced >= len(before)
        assert private.sub("", r.text or "") == private.sub("", docs[r.doc_id].text or "")
        for a, b in zip(before, after):
            made[a].add(b)
    assert len(made) == len(every) > 5 and all(len(v) == 1 for v in made.values())
    assert len({next(iter(v)) for v in made.values()}) == len(made)


ALPHABETS = [("0123456789", r"[0-9]"), ("abcdefghijklmnopqrstuvwxyz", r"[a-z]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[A-Z]")]


def sha(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def plain_surrogate(kind, canon, attempt, key):
    """The surrogate of an entity of the kinds that the given texts hold, in plain Python."""
    keyed = lambda *parts: sha(key, sha(key, *parts))
    number = lambda seed, i: int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:7], 16)

    def in_place(text, seed, alphabets=ALPHABETS):
        out = ""
        for i, c in enumerate(text):
            letters = next((a for a, p in alphabets if re.fullmatch(p, c)), c)
            out += letters[number(seed, i) % len(letters)]
        return out

    def luhn(digits):
        return sum(sum(divmod(int(c) * (i % 2 + 1), 10)) for i, c in enumerate(reversed(digits))) % 10

    seed = keyed(kind, str(attempt), canon)
    changed = in_place(canon, seed)
    if kind == "EMAIL":
        local, domain = canon.split("@", 1)[0], canon.rsplit("@", 1)[1]
        stays = re.search(r"(?:^|\.)(?:example\.[a-z]+|example|test|invalid|localhost)$|\.[^.]+$", domain)[0]
        labels = domain[: len(domain) - len(stays)]
        return f"{in_place(local, seed)}@{in_place(labels, keyed('DOMAIN', labels))}{stays}"
    if kind == "PHONE":
        first = "0" if canon[0] == "0" else "23456789"[number(seed, 900) % 8]
        return first + (changed[1:3] + "555" + changed[6:10] if re.fullmatch(r"\d{3}555\d{4}", canon) else changed[1:])
    if kind == "SSN":
        return "9" + changed[1:]
    if kind == "CARD":
        body = canon[0] + changed[1:-1]
        return body + (str((10 - luhn(body + "0")) % 10) if luhn(canon) == 0 else changed[-1])
    if kind == "IP":
        octet = lambda i, low, n: str(number(seed, i) % n + low)
        a, b = map(int, canon.split(".")[:2])
        if a in (10, 127):
            return ".".join([str(a), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254)])
        if (a, b) == (192, 168):
            return ".".join(["192.168", octet(3, 0, 256), octet(4, 1, 254)])
        if a == 172 and 16 <= b <= 31:
            return ".".join(["172", octet(2, 16, 16), octet(3, 0, 256), octet(4, 1, 254)])
        first = number(seed, 1) % 220 + 3
        return ".".join([str(first + (first in (10, 127, 172, 192, 169))), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254)])
    assert kind == "SECRET"
    prefix = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-)?", canon)[0]
    rest = canon[len(prefix) :]
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", rest):
        return prefix + in_place(rest, seed, [("0123456789", "[0-9]"), ("abcdef", "[a-f]"), ("ABCDEF", "[A-F]")])
    return prefix + in_place(rest, seed, [("234567", "[0-9]"), ALPHABETS[2]] if prefix in ("AKIA", "ASIA") else ALPHABETS)


def plain_replace(texts, key):
    """All texts with surrogates: found by the same patterns, drawn entity by entity until all differ."""
    import regex

    from loomdex.llm import surrogates

    every, kinds = regex.compile(surrogates.PATTERN), {k: regex.compile(p) for k, p in surrogates.KINDS.items()}
    kind_of = lambda x: next((k for k, p in kinds.items() if k != "SECRET" and p.fullmatch(x)), "SECRET")
    secret_name = regex.compile(surrogates._SECRET_NAME)

    def canonical(x):
        kind, digits = kind_of(x), re.sub(r"\D", "", x)
        if kind == "PHONE":
            return kind, digits[1:] if re.fullmatch(r"1\d{10}", digits) else digits
        head = (m := secret_name.match(x)) and m[0] or ""
        return kind, {"EMAIL": x.lower(), "SSN": digits, "CARD": digits, "SECRET": x[len(head) :]}.get(kind, x)

    entities = {canonical(x) for t in texts for x in every.findall(t)}
    made, pending = {}, {e: 0 for e in entities}
    while pending:
        drawn = {e: plain_surrogate(*e, attempt, key) for e, attempt in pending.items()}
        for (kind, canon), m in sorted(drawn.items()):
            if (kind, m) not in entities and (kind, m) not in {(k, v) for (k, _), v in made.items()}:
                made[kind, canon] = m
        pending = {e: attempt + 1 for e, attempt in pending.items() if e not in made}

    def shown(m):
        kind, canon = canonical(m[0])
        new = made[kind, canon]
        if kind in ("PHONE", "SSN", "CARD"):
            digits = iter(re.sub(r"\D", "", m[0])[: len(re.sub(r"\D", "", m[0])) - len(new)] + new)
            return re.sub(r"\d", lambda _: next(digits), m[0])
        if kind == "SECRET":
            return m[0][: len(m[0]) - len(canon)] + new
        return new.upper() if kind == "EMAIL" and m[0] == m[0].upper() else new

    return [every.sub(shown, t) for t in texts]


def test_surrogates_equal_a_plain_version(spark, docs):
    from loomdex.llm.queries import SURROGATE_KEY

    order = sorted(docs)
    want = dict(zip(order, plain_replace([docs[i].text or "" for i in order], SURROGATE_KEY)))
    got = {r.doc_id: r.text or "" for r in rows(spark, "op7_surrogates")}
    assert got == want and sum(want[i] != docs[i].text for i in order) > 5


def test_shards(spark, docs):
    got = rows(spark, "op8_label_propagation")
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for r in got:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_packing(spark, docs, tokenizer):
    check_pieces(rows(spark, "op9_hierarchical_packing"), {i: d.text for i, d in docs.items()}, tokenizer)


def test_byte_bpe(spark, docs):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in rows(spark, "op10_byte_bpe")}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        ids = encoding.encode_ordinary(d.text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_pipeline_stages(spark, docs, tokenizer):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    table = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "private data", "packing"]
    verdicts = {r.doc_id: r.kept for r in rows(spark, "op5_robust_quality")}
    outputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = corpus_pipeline.materialize(stage(spark, table, SF), f"stage-{k}")
        outputs.append(table.collect())
        assert k == 3 or table.columns == columns
    assert {r.doc_id for r in outputs[0]} == {i for i, kept in verdicts.items() if kept}
    assert all(r == docs[r.doc_id] for r in outputs[0])
    order = sorted(r.doc_id for r in outputs[0])
    root, _ = plain_components([docs[i].text for i in order], 5)
    assert sorted(r.doc_id for r in outputs[1]) == [order[k] for k in sorted(set(root))]
    assert {r.doc_id for r in outputs[2]} == {r.doc_id for r in outputs[1]}
    assert all(r.n_chars == len(r.text) for r in outputs[2])
    check_pieces(outputs[3], {r.doc_id: r.text for r in outputs[2]}, tokenizer)
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == table.columns
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, ran.collect())) == sorted(map(key, outputs[3]))


@pytest.mark.parametrize("shape", ["empty", "clashing"])
def test_pipeline_of_odd_tables(spark, shape):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    if shape == "empty":
        table = table.where("false")
    else:
        table = table.selectExpr("*", "1 AS n_words", "'x' AS row", "2 AS kept", "3 AS _key", "4 AS _text_key", "5 AS rid", "6 AS digest", "'g' AS `group`")
    columns = table.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = corpus_pipeline.materialize(stage(spark, table, SF), f"odd-{k}")
        assert k == 3 or table.columns == columns
    assert (table.count() == 0) == (shape == "empty")
