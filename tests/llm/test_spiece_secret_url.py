import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import sentencepiece

from ledgerspark.llm import secret_scan, spiece, url_rules

from .fixture_rows import docs, none

MODEL, VOCAB = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain(spark):
    return [(r.doc_id, r.text or "") for r in docs(spark).select("doc_id", "text").collect()]


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in plain(spark):
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in spiece.digests(docs(spark), MODEL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spiece.digests(none(spark), MODEL).count() == 0
    assert spiece.splits_at_markers(MODEL)


def test_pieces_round_trip_and_small_table(spark, monkeypatch):
    enc = spiece.decode(spiece.encode(docs(spark), MODEL), MODEL)
    assert {r.text for r in enc.collect()} >= {"one two three four", ""}
    monkeypatch.setattr(spiece, "TABLE", 3)
    e, sp = spiece.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in ("a b c d e", "a b a  b\nc", "d e"):
        assert e.ids(t) == np.array(sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()


def base(text):
    found = []
    for kind, pattern, ok in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        found += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secret_scan(spark):
    got = secret_scan.scan(docs(spark), VOCAB, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in plain(spark):
        spans = base(t)
        want.append((i, *(sum(k == x for x, _, _ in spans) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
        assert all(f"{k}:{s}:{e}" in r.spans for r in got if r.doc_id == i and t and r.n_assign + r.n_access + r.n_hex for k, s, e in (spans if len(spans) == r.n_assign + r.n_access + r.n_hex else []))
    assert sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], key=str) == sorted(want, key=str)
    digest = next(r for r in got if r.doc_id == 18)
    assert (digest.n_hex, digest.n_random) == (1, 1)  # the digest is a base span; the key is the method's own
    assert sum(r.n_random for r in got) == 1
    assert secret_scan.scan(none(spark), VOCAB, public_tokenizers.PATTERN).count() == 0


def test_secrets_are_masked_and_documents_stay(spark):
    d = docs(spark)
    out = secret_scan.redacted(d, VOCAB, public_tokenizers.PATTERN)
    assert out.columns == d.columns and out.count() == d.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[17].count("[secret]") == 4 and "hunter2" not in texts[17] and texts[1] is None and texts[4] == "one"


def test_token_ratio(spark):
    enc = secret_scan.vocabulary(VOCAB, public_tokenizers.PATTERN)
    ranks = dict(x.split() for x in open(VOCAB, "rb").read().splitlines() if x)
    assert enc.n_vocab == len(ranks) and enc.encode_ordinary("a")[0] == int(ranks[base64.b64encode(b"a")])
    assert not secret_scan.is_random("internationalization_of_Documents", enc)
    assert not secret_scan.is_random("3F2504E0-4F89-11D3-9A0C-0305E82C3301", enc)
    assert secret_scan.is_random("q7RtX9pLm2VbK4zW8sDf1Gh", enc)


URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/a?x#y", "https://a.b.example.net/de", "x://NET", "x://net/", "x://foo.net?q=/en/", "http://example.com/de/1", "http://www.example.com/fr/1", "http://xexample.com/de/",
    "http://wiki.org/fr/", "http://wiki.org/fr", "http://org/fr/a", "a://b://c.net/", "http://.net/", "http://a\nb.net/en\n/x", "http://example.net/en/" + "y" * 5000,
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"[^/?#]*", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])
    path = re.match(r"[^?#]*", rest[m.end() :])[0]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits) if fits else (0, None, "allow")
    return host, path, rule[1], rule[2]


def test_urls(spark):
    pages = [(i, u, "clash", "clash") for i, u in enumerate(URLS * 3)] + [(None, "http://a.net/", None, None), (4, URLS[4], None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, key string, rng string")
    got = [tuple(r) for r in url_rules.apply_rules(df, url_rules.default_rules(spark), ranges=5).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted([(p[0], *judged(p[1])) for p in pages], key=str)
    assert url_rules.apply_rules(df.limit(0), url_rules.default_rules(spark)).count() == 0
    assert url_rules.apply_rules(df, url_rules.default_rules(spark).limit(0)).filter("verdict <> 'allow' or rule is not null").count() == 0
