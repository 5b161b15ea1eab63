"""Operators on single texts against brute force: words, quality figures, token counts, PII, sampling, WARC."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowspark.llm import minhash_dedup, pii, pii_model, quality_rules, token_counts, warc
from flowspark.llm import sentencepiece_sampling as sp
from flowspark.llm.common import Texts, mix
from flowspark.llm.pii_labels import sample
from flowspark.llm.pii_train import held_out, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int, count: int, parts: list[str]) -> list[str | None]:
    r = random.Random(seed)
    return [r.choice([None, "", " \n "]) if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.choice((1, 6, 80)))) for _ in range(count)]


def test_words_lines_and_repeats():
    rows = texts(1, 300, ["a", "B", "é", " ", " ", "\n", "\t", "a b a b a", "# x\n", "\x1c", "hello ", "Hello world\n"])
    t = Texts.of(pa.array(["skipped", *rows], pa.string()).slice(1))
    words, lines, repeats = t.words(), quality_rules.lines_of(t), quality_rules._repeat_words(t.words())
    for i, text in enumerate(rows):
        w = WORD.findall(text or "")
        assert words.counts()[i] == len(w)
        windows = Counter(zip(w, w[1:], w[2:]))
        marked = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert repeats[i] == len(marked)
        own = [x for x in (text or "").split("\n") if WORD.search(x)]
        at = lines.owner == i
        assert at.sum() == len(own) and len(set(lines.exact[at].tolist())) == len(set(own))
        assert len(set(lines.normal[at].tolist())) == len({" ".join(WORD.findall(x.translate(LOWER))) for x in own})


def test_shingles_and_signatures():
    rows = ["", " ", "One two", "one TWO", "a b c d e f g", "a b c d e f g a b c d e f g", "x " * 50]
    sets = minhash_dedup.shingles(Texts.of(pa.array(rows)))
    for text, s in zip(rows, sets, strict=True):
        w = text.translate(LOWER).split()
        assert len(s) == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w))
    assert minhash_dedup.class_of(sets[2]) == minhash_dedup.class_of(sets[3]) and len(sets[0]) == 0
    sig = minhash_dedup.signatures([sets[4], sets[5]])
    j = len(np.intersect1d(sets[4], sets[5])) / len(np.union1d(sets[4], sets[5]))
    assert abs((sig[0] == sig[1]).mean() - j) < 0.2
    assert minhash_dedup.least_matches(64, 0.85) < 0.85 * 64


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_what_a_worker_remembers_is_bounded_and_changes_no_count(vocabulary, monkeypatch):
    rows = [t or "" for t in texts(3, 200, ["qzxv", "Ünder", "jkw1", " ", "日本", "wq-"])]
    plain = [token_counts.Counter(vocabulary)(t) for t in rows]
    count = token_counts.Counter(vocabulary)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    resets, own = [], count.counts.reset
    monkeypatch.setattr(count.counts, "reset", lambda: resets.append(1) or own())
    assert [count(t) for t in rows] == plain and len(resets) > 5


def test_token_counts_equal_the_library(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = token_counts.Counter(vocabulary)
    rows = [t or "" for t in texts(2, 300, ["the ", "Ünder", "don't", " I'LL", "12345", "  ", "\n\n", "<|endoftext|>", "\x1c\x85", "日本", "😀", "aaaaaaaa", ".,;", " "])] + ["é" * 3000, "x" * 700 + " " * 500]
    assert [count(t) for t in rows] == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]
    points = [chr(c) for c in range(0x250) if not 0xD800 <= c < 0xE000]
    assert [count(f"a{c}b {c}") for c in points] == [len(e.ids) for e in library.encode_batch([f"a{c}b {c}" for c in points], add_special_tokens=False)]
    assert all(vocabulary.merge(w) == 1 for w in list(vocabulary.whole)[:500])


BASE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_by_search(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = (lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15)
    return sorted(((k, *m.span()) for k in range(4) for m in BASE[k].finditer(t) if ok[k](m[0])), key=lambda s: (s[1], s[0], s[2]))


def test_base_spans_equal_a_plain_search():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(r.choice(("0123456789", "ab@.@.-_ %", "0123456789.", "+ 0123456789()-", "é\n٣ 4539578763621486 "))) for _ in range(r.choice((5, 20, 60))))
        assert pii.base_spans(t) == base_by_search(t)
    assert pii.base_spans("a" * 200_000 + "@" * 5 + "1" * 200_000) == []


def test_tagger():
    model = stored()
    precision, recall = held_out(model, count=300)
    assert precision > 0.6 and recall > 0.75
    prose = ["Version 2.0 of the text has 12 parts, 3 of them (at least) new.", "id 123456 at 10:30 on 2024-01-31", "no data here", ""]
    assert all(not every for _, every in pii.find(model, prose))
    added = pii.find(model, ["Write to jane.doe (at) mail.example.com today, or ring (555) 123-4567 at noon."])[0][1]
    assert {pii.KINDS[k] for k, _, _ in added} == {"email", "phone"}
    long = "word " * 300 + "jane@mail.example.com " + "word " * 300 + "(555) 123-4567 " + "word " * 90
    assert pii.find(model, [long], skip=False) == pii.find(model, [long], skip=True)
    assert pii.mask_text("a jane@x.org b", pii.base_spans("a jane@x.org b")) == "a [EMAIL] b"
    assert hashlib.sha256(pii.written([]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_sampled_pieces():
    v = sp.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [t or "" for t in texts(4, 120, [" ", "  ", "▁", "\n", "é", "€", "😀", "a", "the ", "梦", "\x00", "<0x41>", "<s>", "x" * 300])]
    keys = mix(np.arange(len(rows)).astype(np.uint64))
    found = sp.sample(v, rows, keys, 1)
    assert [v.decode(f.tolist()) for f in found] == rows
    again = [sp.sample(v, rows[k : k + 1], keys[k : k + 1], 1)[0] for k in range(len(rows))]
    assert all(np.array_equal(a, b) for a, b in zip(found, again, strict=True))
    assert any(not np.array_equal(a, b) for a, b in zip(found, sp.sample(v, rows, keys, 2), strict=True))


def test_sampling_follows_the_weights():
    named = [(c, s, "text") for c, s in (("a", -1.0), ("b", -1.5), ("ab", -1.2), ("aba", -2.0))] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    v = sp.Vocabulary(named, 1.0, ranked=False)

    def paths(s):
        if not s:
            return {(): 0.0}
        return {(i, *rest): w + x for i, (p, w, k) in enumerate(named) if k == "text" and s.startswith(p) for rest, x in paths(s[len(p) :]).items()}

    want = paths("ababa")
    total = sum(np.exp(list(want.values())))
    n = 40_000
    seen = Counter(tuple(f.tolist()) for f in sp.sample(v, ["ababa"] * n, mix(np.arange(n).astype(np.uint64))))
    assert set(seen) <= set(want)
    for path, w in want.items():
        p = np.exp(w) / total
        assert abs(seen[path] / n - p) < 5 * np.sqrt(p / n) + 1e-4


def test_warc_records():
    page = '<html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One<br>two <b>th</b>ree</p><a href="/x?a=1&amp;b=2">go</a></body></html>'
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + page.encode()
    meta, text = warc.derive_one("<urn:uuid:1>", "http://a/", None, block)
    assert text["block"].decode() == "A & B\nOne\ntwo three\ngo"
    assert meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>" and meta["payload_digest"] == warc.digest(page.encode())
    assert b"title: A & B\r\n" in meta["block"] and b"outlink: /x?a=1&b=2\r\n" in meta["block"] and b"source-header-content-type" in meta["block"]
    parsed = list(warc.parse(meta["record"] + text["record"] + text["record"][:-9]))
    assert [b for _, b in parsed] == [meta["block"], text["block"]]
    assert parsed[1][0]["warc-refers-to"] == "<urn:uuid:1>" and warc.digest(parsed[1][1]) == parsed[1][0]["warc-block-digest"]
    assert warc.derive_one("<urn:uuid:1>", "http://a/", None, block) == [meta, text]
    for odd in ("<", "<<<<" * 50_000, "<!-- " * 50_000, "<script>" * 20_000, ""):
        warc.plain_text(odd)


def test_best_path_and_likelihood_equal_all_paths():
    """Viterbi and the likelihood against every tag path of short windows, written out."""
    ok, first = pii_model.allowed_transitions()
    rng = np.random.default_rng(3)
    model = pii_model.Model.fresh(6, rng)
    model.move[:] = rng.normal(0, 1, model.move.shape)
    x = rng.integers(0, pii_model.CLASSES - 1, (4, 5)).astype(np.uint8)
    e = model.run(x).astype(np.float64)
    found = model.decode(x)
    for n in range(5):
        scores = {}
        for path in itertools.product(range(pii_model.TAGS), repeat=4):
            if first[path[0]] and all(ok[a, b] for a, b in zip(path, path[1:])):
                scores[path] = sum(e[t, path[t], n] for t in range(4)) + sum(float(model.move[a, b]) for a, b in zip(path, path[1:]))
        best = max(scores, key=scores.get)
        assert tuple(found[:, n]) == best
        z = math.log(sum(math.exp(v) for v in scores.values()))
        loss, _ = pii_model.gradients(model, x[:, n : n + 1], np.array(best)[:, None])
        assert math.isclose(loss, z - scores[best], rel_tol=1e-4, abs_tol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    model = pii_model.Model.fresh(5, rng)
    x = rng.integers(0, pii_model.CLASSES - 1, (7, 3)).astype(np.uint8)
    x[5:, 1] = pii_model.PAD
    tags = rng.integers(0, 2, (7, 3)).astype(np.int64)
    loss, grads = pii_model.gradients(model, x, tags)
    for p, g in zip(model.parameters(), grads, strict=True):
        direction = g / (np.sqrt((g * g).sum()) + 1e-12)
        step, own = 1e-2, p.copy()
        sides = []
        for sign in (1, -1):
            p[...] = own + (sign * step * direction).astype(p.dtype)
            sides.append(pii_model.gradients(model, x, tags)[0])
        p[...] = own
        assert math.isclose((sides[0] - sides[1]) / (2 * step), math.sqrt(float((g * g).sum())), rel_tol=0.05, abs_tol=1e-3)


def test_training_learns_from_labelled_spans():
    """A small tagger trained here from the generated spans finds many that it never saw; an untrained one finds none worth it."""
    x, y, _ = sample(11, 6000, 64)
    trained = pii_model.train(x, y, hidden=20, epochs=6, batch=32, rate=0.02)
    precision, recall = held_out(trained, count=200)
    blank, _ = held_out(pii_model.Model.fresh(20, np.random.default_rng(0)), count=200)
    assert recall > 0.3 and precision > 0.3 > blank


class _Reader(HTMLParser):
    """What a reader sees of a page, and its title, language and links, by the standard library's parser."""

    HIDDEN = ("script", "style", "noscript", "template", "svg")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.lang, self.title, self.hidden, self.inside = [], [], None, None, [], False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.hidden or tag in self.HIDDEN:
            self.hidden += [tag] if tag in self.HIDDEN else []
            return
        self.inside = tag == "title"
        if tag == "html":
            self.lang = attrs.get("lang")
        if tag == "a" and "href" in attrs:
            self.links.append(" ".join(attrs["href"].split()))
        self.parts.append("" if tag in warc._INLINE else "\n")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        self.inside = False
        self.parts.append("" if tag in warc._INLINE else "\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.inside and self.title is None:
                self.title = " ".join(data.split())

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def test_warc_derivatives_equal_the_standard_parser():
    """Every page of a table: text, title, language, links, headers and digests against an independent reading."""
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    rows += [{"page_id": -1, "url": "u", "html": "<html lang=de><title>T</title><body>" + "<p>a very long page</p>" * 40_000 + "</body></html>"}, {"page_id": -2, "url": None, "html": ""}]
    for r in rows:
        payload = (r["html"] or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-A: b\r\n\r\n" + payload
        meta, text = warc.derive_one("<urn:x>", r["url"], None, block, [("warc-payload-digest", "sha1:AA")])
        page = _Reader()
        page.feed(r["html"] or "")
        page.close()
        assert text["block"].decode() == page.text(), r["page_id"]
        fields = meta["block"].decode().split("\r\n")
        assert fields[:4] == ["source-status: HTTP/1.1 200 OK", "source-header-content-type: text/html; charset=utf-8", "source-header-x-a: b", "warc-source-payload-digest: sha1:AA"]
        assert [x.removeprefix("outlink: ") for x in fields if x.startswith("outlink: ")] == page.links
        assert [x.removeprefix("language: ") for x in fields if x.startswith("language: ")] == ([page.lang] if page.lang else [])
        want = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for x in (meta, text):
            assert (x["refers_to"], x["payload_digest"], x["target_uri"]) == ("<urn:x>", want, r["url"])
            assert x["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(x["block"]).digest()).decode()
            (headers, body), = warc.parse(x["record"])
            assert body == x["block"] and headers["warc-refers-to"] == "<urn:x>" and headers.get("warc-target-uri") == r["url"]
