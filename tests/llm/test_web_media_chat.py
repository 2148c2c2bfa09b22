"""Pages, archives, audio and conversations: round trips, brute force and awkward rows."""

import hashlib
import os
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA
from fixtures import words
from terraspan.llm import op4_telephony, op6_chat, op7_html, op8_warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-nav">
<div class="site-header">Site</div><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class='ad'>Buy</div><form>Name <input></form>
<article class="post share"><header><h1>Ti&amp;tle</h1></header><p>One <i>t</i>wo<br>three<!-- no --><p>Four &lt;x&gt; &copy &#233;
  and&nbsp;more</p><aside>see also</aside><div id="comment-list"><p>troll</p></div><noscript>no</noscript><p hidden>gone</p><p>Last &am</article>
<section class="comments">c</section><footer>f</footer>"""


def test_main_text():
    assert op7_html.assemble(op7_html.blocks(PAGE), [])[0] == "Ti&tle One two three Four <x> © é and more Last &am"


@pytest.mark.parametrize("html", ["", "<", "<p", "</p>", "<script>", "<!--", "<article>", "a<b>c", "<p>x</div></p>y", "<SCRIPT>x</SCRIPT >y", "&", "<div " + "a" * 5000])
def test_broken_markup(html):
    assert isinstance(op7_html.assemble(op7_html.blocks(html), [])[0], str)


def text_of(html):
    return op7_html.assemble(op7_html.blocks(html), [])[0]


def test_a_slash_closes_no_script():
    assert text_of('<article><p>a</p><script src="x"/>var leaked=1;</script><p>b</p><style/>p{}</style><textarea/>t</textarea>c</article>') == "a b c"
    assert text_of("<article><svg><script/><text>in</text></svg><p>b</p></article>") == "in b"


def test_parts_of_a_class_are_hints_only():
    """Whole classes, and containers of adverts and comments, are chrome in an article; a longer name that has such a word isn't."""
    kept = ['<p id="social-policy">', '<section class="search-results">', '<p class="comment-on-it">', '<div class="market-share figures">', '<h2 id="notice-of-sale">']
    gone = ['<div class="share">', '<p class="x advert">', '<div id="comment-list">', '<section class="post-comments">', '<ul class="ad-slot">', '<div role="search">', '<p hidden>', '<div class="newsletter big">']
    for tag in kept + gone:
        page = op7_html.blocks(f"<article><p>one</p>{tag}two</article>")
        assert [z for z, _ in page][1] in ({op7_html.SUSPECT} if tag in kept else {op7_html.MARKED}), tag
        assert op7_html.assemble(page, [])[0] == ("one two" if tag in kept else "one")


def test_the_array_decides_suspect_blocks(spark):
    """The same markup on every page of a host: what the pages repeat goes, long or short, what is each page's own stays."""
    links, more = "follow our good people on every network you like", "Read more"
    page = lambda k, host, short=more: (k, f"http://{host}/{k}", f'<article><p>{words(20, k)}</p><div class="social-links">{links} {words(3, 700 + k)}</div><p id="share-of-trade">{words(15, 300 + k)}</p><p class="related-note">{short}</p><p>{more} end</p></article>')
    rows = [page(1, "a"), page(2, "a"), page(3, "b"), (4, *page(3, "b")[1:]), page(5, "c", "Only here"), page(6, "c", "And there")]
    got = {r.page_id: r.text for r in op7_html.extract(pages(spark, rows)).collect()}
    own = lambda k: f"{words(20, k)} {{}}{words(3, 700 + k)} {words(15, 300 + k)}"
    for k in (1, 2):
        assert got[k] == own(k).format("") + f" {more} end" != text_of(rows[k - 1][2])
    assert got[3] == got[4] == own(3).format(links + " ") + f" {more} {more} end" == text_of(rows[2][2])
    assert got[5] == own(5).format("") + f" Only here {more} end"


class Reference(HTMLParser):
    """The text of articles by the parser of the standard library, for pages as plain as the given ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside, self.skip = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("aside", "nav", "form", "footer", "script", "style", "header") or dict(attrs).get("class") == "ad"
        self.out += [""] * (tag in ("p", "div", "h1", "h2", "br", "li", "ul", "blockquote"))

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("aside", "nav", "form", "footer", "script", "style", "header")
        self.out += [""] * (tag in ("p", "div", "h1", "h2", "li", "ul", "blockquote", "article"))

    def handle_data(self, data):
        if self.inside and self.skip <= 0:
            self.out[-1] += data


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_given_pages_against_another_parser(spark):
    got = {(r.page_id, r.url): r.text for r in op7_html.query(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len({(r.page_id, r.url) for r in rows})
    for r in rows:
        html = r.html or ""
        inner = html[html.find("<article") : html.rfind("</article>") + 10] if "<article" in html else ""
        p = Reference()
        p.feed(inner)
        p.close()
        want = " ".join(" ".join(x.split()) for x in p.out if x.split())
        assert got[r.page_id, r.url] == want, r.page_id


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("_page", "host", "blocks", "starts", "text", "digest", "size")})


def open_page(body, k):
    shared = "<div>all rights reserved by the very good company of this town</div>"
    return (k, f"http://a.example/{k}", f"<body><div>{body}</div>{shared}<div>tail {k}</div></body>")


@pytest.mark.parametrize("unit", ["<a ", '"', '<a href="x', "<div>", "<div></p></section>", "<", "</", "<!--", "<p '", "<script>", "<!"])
def test_malformed_pages_are_read_in_linear_time(unit):
    import time

    html = (unit * (1 + (1 << 19) // len(unit)))[: 1 << 19]
    began = time.process_time()
    op7_html.blocks(html)
    assert time.process_time() - began < 4


def test_what_the_array_removes_and_what_markup_removes(spark):
    """Pages with articles: repeated words go by the array, whatever their markup; unique open text stays; what is repeated in articles stays."""
    shared, quote = "all rights reserved by the very good company", words(30, 77)
    page = lambda k, host: (k, f"http://{host}/{k}", f"<nav>home news sport</nav><article><p>{quote}</p><p>{words(20, k)}</p></article><div>{words(9, 50 + k)} {shared}</div><aside>{words(7, 90 + k)}</aside><footer>{shared}</footer>")
    rows = [page(1, "a"), page(2, "a"), page(3, "b"), (4, *page(3, "b")[1:])]
    got = {r.page_id: (r.text, r.n_repeated, r.n_marked) for r in op7_html.extract(pages(spark, rows)).collect()}
    for k in (1, 2):
        assert got[k] == (f"{quote} {words(20, k)} {words(9, 50 + k)}", 16, 10)
    assert got[3] == got[4] == (f"{quote} {words(20, 3)} {words(9, 53)} {shared}", 0, 18)


def test_shared_runs_of_open_pages(spark):
    rows = [open_page(words(12, k), k) for k in range(3)] + [(9, "http://b.example/", open_page("x", 9)[2]), (10, None, None), (11, "::", ""), (0, *open_page(words(12, 0), 0)[1:])]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in op7_html.extract(pages(spark, rows)).collect()}
    assert got[1, "http://a.example/1"][0] == words(12, 1) + " 1"  # "tail" belongs to the shared run
    assert "rights reserved" in got[9, "http://b.example/"][0]
    assert got[10, None] == ("", 0) and got[11, "::"] == ("", 0)
    assert op7_html.extract(pages(spark, [])).count() == 0


def test_coverage_against_brute_force():
    """A word is covered if it lies in a substring of DEPTH words that another page of the host has."""
    r = random.Random(2)
    streams = [[f"t{r.randrange(3)}" for _ in range(40)] for _ in range(6)]
    parsed = [[(op7_html.OPEN, " ".join(s))] for s in streams]
    keys = [op7_html.suffixes("h", p, 5) for p in parsed]
    for i, s in enumerate(streams):
        others = {tuple(o[k : k + 5]) for j, o in enumerate(streams) if j != i for k in range(len(o) - 4)}
        shared = {k[1:] for j, ks in enumerate(keys) if j != i for k in ks}
        want = [w for k, w in enumerate(s) if not any(tuple(s[a : a + 5]) in others for a in range(max(0, k - 4), min(k, len(s) - 5) + 1))]
        assert op7_html.assemble(parsed[i], [k[0] for k in keys[i] if k[1:] in shared], 5)[0] == " ".join(want)


def test_archives(spark, tmp_path):
    long = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1", long), (2, "http://a\r\n/2", long), (5, None, long), (3, "u", "é" * 100), (4, "u", "é" * 100), (6, "u", None), (None, "u", long), (7, "u", words(40_000))]
    path = str(tmp_path / "w")
    op8_warc.write(pages(spark, rows), path)
    got = {r.page_id: r for r in op8_warc.read(spark, path).collect()}
    assert len(got) == 8 and {k: r.record_type for k, r in got.items() if r.record_type == "revisit"} == {1: "revisit", 2: "revisit", None: "revisit"}
    assert got[1].refers_to == 5 and got[1].payload == "" and got[1].payload_bytes == len(long.encode()) and got[5].payload == long
    assert got[7].payload == words(40_000) and got[6].payload_bytes == 0 and got[2].target_uri == "http://a/2"
    assert all(r.payload_digest == hashlib.sha1((dict((k, h) for k, _, h in rows)[k] or "").encode()).hexdigest() for k, r in got.items())
    narrow = op8_warc.read(spark, path, "page_id,record_type").filter("record_type = 'revisit' and page_id in (1, 5)")
    assert [r.page_id for r in narrow.collect()] == [1]
    op8_warc.write(pages(spark, []), path + "0")
    assert op8_warc.read(spark, path + "0").count() == 0


def test_reader_in_small_pieces(spark, tmp_path, monkeypatch):
    """Headers and payloads across the ends of pieces, and payloads that are stepped over."""
    rows = [(k, f"http://a/{k}", words(r, k)) for k, r in enumerate([0, 1, 400, 3, 2000, 50, 0, 900])]
    op8_warc.write(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    for piece in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(op8_warc, "PIECE", piece)
        for columns in (["page_id", "payload"], ["page_id"]):
            reader = op8_warc.WarcReader(str(tmp_path / "w"), columns)
            got = [r for p in reader.partitions() for r in reader.read(p)]
            assert sorted(got) == [(k, h) if "payload" in columns else (k,) for k, _, h in rows]


def test_pushed_predicates():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = op8_warc.WarcReader("x", ["page_id"])
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("payload_bytes",), 5)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"response"}, "page_id": {1, 2}}


def slow_adpcm(block):
    """IMA ADPCM, a nibble at a time."""
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(op4_telephony.STEPS[index])
            diff = step >> 3
            diff += (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + int(op4_telephony.INDEX_STEPS[code])))
            out.append(sample)
    return out


@pytest.mark.parametrize("rate, target", [(8000, 16000), (8000, 11025), (16000, 8000), (8000, 8000)])
def test_resampling_in_slices(monkeypatch, rate, target):
    """By the definition, a sample at a time, whatever the slices; from codes too."""
    codes = np.random.default_rng(3).integers(0, 256, 700, dtype=np.uint8)
    pcm = op4_telephony.MULAW_TABLE[codes]
    want = []
    for k in range(len(pcm) * target // rate):
        left, part = divmod(k * rate, target)
        want.append((int(pcm[left]) * (target - part) + int(pcm[min(left + 1, len(pcm) - 1)]) * part) // target)
    for slice_ in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(op4_telephony, "SLICE", slice_)
        assert op4_telephony.resample(pcm, rate, target).tolist() == want
        assert np.concatenate(list(op4_telephony.resampled(codes, rate, target, op4_telephony.MULAW_TABLE))).tolist() == want
    assert op4_telephony.resample(pcm[:0], rate, target).tolist() == []


def test_codecs():
    data = np.random.default_rng(0).integers(0, 256, 576 * 3, dtype=np.uint8)
    assert op4_telephony.decode_adpcm(data).tolist() == [slow_adpcm(data[k : k + 576].tobytes()) for k in range(0, len(data), 576)]
    mu, a = op4_telephony.MULAW_TABLE, op4_telephony.ALAW_TABLE
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0x2A], a[0xAA], a[0xD5], a[0x55]) == (-32256, 32256, 8, -8)
    codes = np.array([c for c in range(256) if c != 127], dtype=np.uint8)
    assert (op4_telephony.encode_mulaw(mu[codes]) == codes).all()
    pcm = np.array([0, 100, -100], dtype=np.int16)
    assert op4_telephony.resample(pcm).tolist() == [0, 50, 100, 0, -100, -100] and len(op4_telephony.resample(pcm[:0])) == 0


@pytest.mark.parametrize("text", [None, "", "a", "é" * 288, "x" * 576, "y" * 577, words(20_000)])
def test_media_round_trip(monkeypatch, text):
    n, payload = op4_telephony.payload_of(text)
    media = op4_telephony.wav(payload)
    got = op4_telephony.features_of([media])[0]
    data = (text or "").encode()
    want = data + b"\xff" * (-len(data) % 576 if data else 576)
    assert payload == want and n == len(data)
    assert got["payload_sha256"] == hashlib.sha256(want).hexdigest() and got["tail_crc32"] == zlib.crc32(want[-32:])
    assert op4_telephony.read_wav(media) == (op4_telephony.MULAW, 8000, want) and got["media_sha256"] == hashlib.sha256(media).hexdigest()
    wide = op4_telephony.read_wav(op4_telephony.to_pcm(media))
    assert wide[:2] == (op4_telephony.PCM, 16000) and len(wide[2]) == 4 * len(want) and f"pcm16k_crc={zlib.crc32(wide[2])}" in got["feature"]
    pcm = op4_telephony.MULAW_TABLE[np.frombuffer(want, np.uint8)].tolist()
    assert f"crossings={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))};" in got["feature"] and f"mulaw_rms={int((sum(x * x for x in pcm) // len(pcm)) ** 0.5)};" in got["feature"]
    monkeypatch.setattr(op4_telephony, "SLICE", 2 * 576)
    assert op4_telephony.features_of([media] * 3) == [got] * 3


def test_media_columns(spark, tmp_path):
    """Files written as columns, read back and described."""
    from fixtures import AWKWARD, documents

    docs = documents(spark, AWKWARD, clash=True)
    op4_telephony.store(docs, docs.columns, pcm=True).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    got = sorted(((r.doc_id, r.n_bytes, r.payload_sha256, bytes(r.pcm)) for r in op4_telephony.described(stored).collect()), key=str)
    made = [op4_telephony.payload_of(t) for _, t in AWKWARD]
    want = [(i, n, hashlib.sha256(p).hexdigest(), op4_telephony.to_pcm(op4_telephony.wav(p))) for (i, _), (n, p) in zip(AWKWARD, made)]
    assert got == sorted(want, key=str)


def test_the_query_stores_resampled_pcm(spark, monkeypatch):
    """Both files of every document are in the shared folder, and the features are those of what is read back."""
    from fixtures import AWKWARD, documents

    kept = []
    monkeypatch.setattr(op4_telephony, "table", lambda *_: documents(spark, AWKWARD))
    write = op4_telephony.materialize
    monkeypatch.setattr(op4_telephony, "materialize", lambda df, **options: kept.append(write(df, **options)) or kept[-1])
    got = {(r.doc_id, r.payload_sha256): r.feature for r in op4_telephony.query(spark, "").collect()}
    files = {(r.doc_id, hashlib.sha256(op4_telephony.read_wav(bytes(r.media))[2]).hexdigest()): bytes(r.pcm) for r in kept[0].collect()}
    want = {}
    for i, t in AWKWARD:
        payload = op4_telephony.payload_of(t)[1]
        want[i, hashlib.sha256(payload).hexdigest()] = op4_telephony.to_pcm(op4_telephony.wav(payload))
    assert files == want and set(got) == set(want)
    assert all(f";pcm16k_samples={len(want[k]) // 2 - 22};pcm16k_crc={zlib.crc32(want[k][44:])}" in f for k, f in got.items())
    other = kept[0].withColumn("pcm", F.lit(op4_telephony.wav(b"ab", op4_telephony.PCM, 16_000, 16)))
    assert all(f"pcm16k_samples=1;pcm16k_crc={zlib.crc32(b'ab')}" in r.feature for r in op4_telephony.described(other).collect())


def test_the_query_stores_copies_together(spark, monkeypatch):
    """Two copies of each text, farther apart than the compressor looks back, take about the space of one; no row is lost."""
    from fixtures import documents

    r = random.Random(5)
    texts = ["".join(r.choices([chr(c) for c in range(33, 127)], k=150_000)) for _ in range(8)]
    docs, kept = documents(spark, list(enumerate(texts * 2))).coalesce(1), []
    write = op4_telephony.materialize
    monkeypatch.setattr(op4_telephony, "table", lambda *_: docs)
    monkeypatch.setattr(op4_telephony, "materialize", lambda df, **options: kept.append(write(df, **options)) or kept[-1])
    got = {x.doc_id: x.payload_sha256 for x in op4_telephony.query(spark, "").collect()}
    assert got == {i: hashlib.sha256(op4_telephony.payload_of(t)[1]).hexdigest() for i, t in enumerate(texts * 2)}
    as_given = write(kept[0].orderBy("doc_id").coalesce(1), **op4_telephony.WRITING)
    assert as_given.count() == len(texts) * 2
    sizes = [sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles()) for df in (kept[0], as_given)]
    assert sizes[0] < 0.75 * sizes[1]


def test_call_levels(spark):
    r = random.Random(4)
    for loops in (False, True):
        edges = {(str(i), str(j)) for i in range(50) for j in r.sample(range(50 if loops else max(1, i)), 1) + ([r.randrange(max(1, i))] if r.random() < 0.4 else []) if i != j}
        depends = {str(i): [b for a, b in edges if a == str(i)] for i in range(50)}
        want, grown = {}, True
        while grown:
            grown = False
            for k, v in depends.items():
                if k not in want and all(x in want for x in v):
                    want[k], grown = 1 + max((want[x] for x in v), default=-1), True
        calls = spark.createDataFrame([(k,) for k in depends], "call_id string")
        got = {x.call_id: x.level for x in op6_chat.levels(calls, spark.createDataFrame(sorted(edges), "call_id string, on_id string")).collect()}
        assert got == want


def test_cycles_of_needless_edges_stay_cycles(spark):
    """Each edge among a, b and c has a way over two others; d hangs on them, e doesn't."""
    edges = [(x, y) for x in "abc" for y in "abc" if x != y] + [("d", "a"), ("d", "e"), ("f", "e"), ("f", "g"), ("g", "e")]
    calls = spark.createDataFrame([(x,) for x in "abcdefg"], "call_id string")
    got = {x.call_id: x.level for x in op6_chat.levels(calls, spark.createDataFrame(edges, "call_id string, on_id string")).collect()}
    assert got == {"e": 0, "g": 1, "f": 2}


def test_a_thousand_turns_take_a_few_rounds(spark):
    """Every call names the two before it: the needless edges go, and the chain is measured by doubling."""
    import time

    n = 1000
    calls = spark.createDataFrame([(str(k),) for k in range(n)], "call_id string")
    edges = spark.createDataFrame([(str(k), str(k - d)) for k in range(n) for d in (1, 2) if k >= d], "call_id string, on_id string")
    began = time.monotonic()
    assert {x.call_id: x.level for x in op6_chat.levels(calls, edges).collect()} == {str(k): k for k in range(n)}
    assert time.monotonic() - began < 60


def test_nested_arguments(spark):
    """Objects in objects, arrays of objects, lists of allowed values: faults by path, canonical form in key order."""
    import json

    schemas = {"t": {"to": ({"name": ("string", True), "tags": ([{"k": (("a", "b"), True), "w": ("number", False)}], False)}, True), "rows": ([["integer"]], False), "none": ({}, False)}}
    given = [
        {"to": {"tags": [{"w": 2.0, "k": "b"}, {"k": "a", "w": 0.5}], "name": "é"}, "rows": [[1, 2], []]}, {"to": {"name": 1, "tags": [{"k": "c"}, {"w": "x"}], "more": 0}}, {"rows": [1, ["x"], [1.5]]}, {"to": []}, {"to": None, "rows": {}}, {"to": {"name": ""}, "none": {}},
        {"to": {"name": "x"}, "none": {"y": 1}},
    ]
    want = [
        "", "missing to.tags[].k,type to.name,type to.tags[].w,unexpected to.more,value to.tags[].k", "missing to,type rows[],type rows[][]", "type to", "type rows,type to", "", "unexpected none.y",
    ]
    calls = spark.createDataFrame([(str(k), "t", json.dumps(a), None) for k, a in enumerate(given)], "call_id string, name string, arguments string, depends array<string>")
    got = {r.call_id: r for r in op6_chat.link(calls, spark.createDataFrame([], "call_id string, content string"), schemas).collect()}
    assert [got[str(k)].errors for k in range(len(given))] == want
    assert '"arguments":{"rows":[[1,2],[]],"to":{"name":"é","tags":[{"k":"b","w":2},{"k":"a","w":0.5}]}},' in got["0"].record and '"arguments":{"none":{},"to":{"name":""}},' in got["5"].record
    assert all(json.loads(r.record) for r in got.values())


def test_linking(spark):
    calls = spark.createDataFrame([
        ("a", "reply", '{"words": 2, "prompt": "x \\"y\\""}', None), ("b", "reply", '{"prompt": 5}', ["a", "zz"]), ("c", "dance", "{}", ["b"]), ("d", "configure", "not json", []),
        ("e", "reply", '{"words": 1, "prompt": "p", "more": 1}', ["e"]), (None, "reply", None, ["a"]),
    ], "call_id string, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([("a", "line\né"), ("a", "zzz"), ("q", "lost")], "call_id string, content string")
    got = {r.call_id: r for r in op6_chat.link(calls, results).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, None: 0}
    assert {k: r.errors for k, r in got.items()} == {"a": "", "b": "missing words,type prompt", "c": "unknown tool", "d": "not an object", "e": "unexpected more", None: "not an object"}
    assert got["a"].record == '{"arguments":{"prompt":"x \\"y\\"","words":2},"depends":[],"id":"a","level":0,"name":"reply","result":"line\\né","valid":true}'
    assert got["b"].depends == ["a"] and not got["c"].answered


def test_records_are_json(spark):
    """Every record is read back by a JSON parser, whatever ids, keys, numbers and texts hold."""
    import json

    odd = 'a"b\\c\n\x00\x1f\u2028é'
    schemas = {"t": {"s": ("string", False), "i": ("integer", False), "n": ("number", False), "b": ("boolean", False)}}
    given = ['{"i": 1.0, "n": 1e2}', '{"n":0.5,"b":true,"s":' + json.dumps(odd) + "}", '{"i":1.5}', '{"s":1,"s":2}', odd, "[1]", "{}", '{"i":9007199254740993}', json.dumps({"s": "x" * 3_000_000})]
    calls = spark.createDataFrame([(odd + str(k), "t", a, [odd + str(k - 1)]) for k, a in enumerate(given)], "call_id string, name string, arguments string, depends array<string>")
    got = {r.call_id: (json.loads(r.record), r.record) for r in op6_chat.link(calls, spark.createDataFrame([(odd + "0", odd)], "call_id string, content string"), schemas).collect()}
    args = [got[odd + str(k)][0]["arguments"] for k in range(len(given))]
    assert args[:8] == [{"i": 1, "n": 100}, {"b": True, "n": 0.5, "s": odd}, *given[2:6], {}, {"i": 9007199254740993}] and args[8]["s"] == "x" * 3_000_000
    assert '"arguments":{"i":1,"n":100}' in got[odd + "0"][1] and got[odd + "0"][0]["result"] == odd and got[odd + "1"][0]["depends"] == [odd + "0"]
    assert [got[odd + str(k)][0]["valid"] for k in range(9)] == [True, True, False, False, False, False, True, True, True]


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", None), (None, 0, "user", "x"), (1, None, "system", "y"), (2, 0, "tool", "z"), (2, 1, None, "w")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("clash"))
    got = op6_chat.link(*op6_chat.calls_of(talk)).collect()
    assert sorted((str(r.call_id), r.level, r.answered) for r in got) == [("1-0", 0, True), ("1-2", 1, False), ("None", 0, False), ("None", 0, False)]
    assert op6_chat.link(*op6_chat.calls_of(talk.limit(0))).count() == 0
