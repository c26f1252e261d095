"""Text operators against the libraries and brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import bpe, chat, counts, extract, packing, simhash, vocab

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxicity string"
TEXTS = ["Hello world, it's a test of words.", "", None, "  two  spaces \n\tx ", "日本語 テキスト é ﬁ 😀", "a" * 700, "x " * 3000, "<|endoftext|> </s> <s>", "don't stop 123 4567", "Hello world, it's a test of words.", "ünïcode ßtraße — “q” z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s", 0, "clash"), (None, "no id", "en", "s", 0, "clash")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_split_is_the_pattern():
    import regex

    for t in filter(None, TEXTS):
        assert vocab.pieces_of(t) == regex.findall(vocab.PATTERN, t)


def test_bpe_is_the_library(docs, empty):
    path = vocab.default_path("byte_bpe_multi_50k.tiktoken")
    library = vocab.rank_encoding(path)
    rows = bpe.encode(docs).withColumn("bytes", bpe.decode("ids")).collect()
    want = sorted((-1 if i is None else i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.bytes)) for r in rows) == want
    assert bpe.encode(empty).count() == 0
    assert docs.sparkSession.sql("select cast(null as array<int>) ids").select(bpe.decode("ids").alias("b")).first().b is None


def test_bpe_of_long_matches(spark):
    """Matches of the split pattern beyond one fold's length, whose parts are joined at seams."""
    rng = random.Random(5)
    library = vocab.rank_encoding(vocab.default_path("byte_bpe_multi_50k.tiktoken"))
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeinorst", "漢字仮名交", "=-_", "é", "the") for n in (127, 128, 129, 700, 3000)]
    texts = [*words, "a" * 20_000, " ".join(words), "x\n\n" + "internationalisation" * 200 + " end", " " * 1000, "\n" * 513]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(docs).withColumn("bytes", bpe.decode("ids")).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(text) and bytes(got[i].bytes) == text.encode(), i


def test_blocks_of_documents(spark):
    """Many blocks and rows give what one gives."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 90))) for _ in range(300)]
    library = vocab.rank_encoding(vocab.default_path("byte_bpe_multi_50k.tiktoken"))
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_chars=3000, row_chars=500).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_counts_at_every_prefix(docs, empty):
    import sentencepiece

    path = vocab.default_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in counts.prefix_counts(docs).join(docs.where("doc_id > 0").select("doc_id", "text"), "doc_id").collect():
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text)) and r.n_bytes == len(text.encode())
        assert len(r.counts) == len(text)
        for end, n in enumerate(r.counts[:20], 1):
            assert n == len(library.encode(text[:end])), (text, end)
    assert counts.prefix_counts(empty).count() == 0
    fit = counts.prefix_counts(docs.where("doc_id = 8")).select(counts.fitting_chars(3).alias("n")).first().n
    assert len(library.encode(TEXTS[8][:fit])) <= 3 < len(library.encode(TEXTS[8]))


def test_budget_inside_long_units(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocab.default_path("piece_bpe_32k.model"))
    texts = ["漢字仮名交じり文" * 900, "aGVsbG8gd29ybGQ" * 400, "first = 1\nsecond\n" * 300, "  two  spaces \n\tx ▁y", "internationalization of words ", "a-b_c2d (e) f'g <h> 12,3.4 x² ½ e\u0301 ñ", "▁▁ a ▁b", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in counts.prefix_counts(docs, budget=500, block_chars=2000, row_chars=200).withColumn("fit", counts.fitting_chars(500)).collect():
        text = texts[r.doc_id]
        assert len(r.counts) == len(text) and r.n_tokens == len(library.encode(text)) and r.fit == r.fitting_chars
        if not text:
            assert r.n_tokens == r.fit == 0
            continue
        for end in [*range(1, min(len(text), 60) + 1), *range(997, len(text), 997)]:
            assert r.counts[end - 1] == len(library.encode(text[:end])), (text[:end],)
        assert r.n_tokens == r.counts[-1] and 0 < len(library.encode(text[: r.fit])) <= 500
        assert r.fit == len(text) or all(len(library.encode(text[:n])) > 500 for n in range(r.fit + 1, r.fit + 20))


def test_packing_covers_all_tokens(docs, empty):
    library = vocab.json_tokenizer(vocab.default_path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(by_doc[i], key=lambda r: r.start)
        if i == 0:
            got = got[:1]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want and got[0].doc_tokens == len(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    digest = packing.packed_digest(docs).where("doc_id = 8").first()
    assert digest.ids_crc32 == zlib.crc32(np.array(library.encode(TEXTS[8]).ids + [1], "<u4").tobytes())
    assert packing.packed_digest(empty).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(0)
    lengths = [rng.randint(1, 2048) for _ in range(3000)] + [2048] * 50
    hist = {n: lengths.count(n) for n in set(lengths)}
    used, sequences = {}, 0
    for parts, times in packing.plan(hist):
        assert sum(n * m for n, m in parts) <= 2048
        sequences += times
        for n, m in parts:
            used[n] = used.get(n, 0) + m * times
    assert used == hist and sum(lengths) / (sequences * 2048) > 0.96


def brute_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_fingerprints(docs):
    got = {r.doc_id: r.fp % 2 ** 64 for r in simhash.fingerprints(docs.where("doc_id is not null")).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}


def roots_of(ids, values, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if near(values[a], values[b]):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_connect_all_near_fingerprints(spark, tile):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for v in base[:6]:
        for _ in range(60):
            w = v
            for _ in range(rng.randint(1, 5)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    values = sorted(v - 2 ** 64 if v >= 2 ** 63 else v for v in values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), tile).collect()
    near = lambda a, b: ((a ^ b) % 2 ** 64).bit_count() <= 4
    assert all(near(r.u, r.v) for r in found)
    linked = {(r.u, r.v) for r in found} | {(r.v, r.u) for r in found}
    assert roots_of(values, values, near) == roots_of(values, values, lambda a, b: (a, b) in linked)


def test_simhash_groups(spark, docs, empty):
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    want = roots_of(list(range(len(TEXTS))), [brute_fingerprint(t) for t in TEXTS], lambda a, b: (a ^ b).bit_count() <= 4)
    assert {k: v for k, v in got.items() if k is not None} == want
    assert simhash.simhash_groups(docs).count() == docs.count() and simhash.simhash_groups(empty).count() == 0


# ---- chat

def test_template_language():
    render = chat.compile_template("{% if first and role == 'user' %}A{% elif not last %}B{% else %}{{ 'x' + 'y' | upper }}{% endif %}{# c #}", ())
    scope = {"role": "user", "content": "", "first": True, "last": False, "previous_role": None}
    assert render(scope) == [("A", False)] and render(scope | {"first": False, "last": True}) == [("xY", False)]
    assert chat.fold(chat.parse("a{% if true %}b{{ 'c' }}{% endif %}")) == (chat.Text("abc"),)
    for bad in ("{{ __import__ }}", "{{ content.x }}", "{% for x %}", "{% if role %}", "{{ content | system }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad, ())


def test_template_with_a_loop():
    """What stands before and after the loop comes once; the turns one after another are the whole template."""
    render = chat.compile_template("A{{ 'b' | upper }}{% for t in turns %}{% if loop.first %}({% endif %}{{ t.role }}:{% generation %}{{ t.content }}{% endgeneration %}{% if loop.previous_role == t.role %}!{% endif %}{% if loop.last %}){% else %},{% endif %}{% endfor %}Z", ())
    turns = [("user", "x"), ("user", "y"), ("assistant", "z")]
    parts = [render({"role": r, "content": c, "first": i == 0, "last": i == 2, "previous_role": turns[i - 1][0] if i else None}) for i, (r, c) in enumerate(turns)]
    assert "".join(t for p in parts for t, _ in p) == "AB(user:x,user:y!,assistant:z)Z" and [t for p in parts for t, m in p if m] == ["x", "y", "z"]
    assert render({"role": "user", "content": "q", "first": True, "last": True, "previous_role": None}) == [("AB", False), ("(", False), ("user", False), (":", False), ("q", True), (")", False), ("Z", False)]
    assert chat.fold(chat.parse("a{{ 'b' }}{% for t in turns %}{{ 'c' }}d{% endfor %}")) == (chat.Text("ab"), chat.For((chat.Text("cd"),)))
    for bad in ("{% for t in turns %}{{ role }}{% endfor %}", "{% for t in turns %}{% endfor %}{{ t.role }}", "{% for t in turns %}", "{% for t in rows %}{% endfor %}", "{% for loop in turns %}{% endfor %}",
                "{% if true %}{% for t in turns %}{% endfor %}{% endif %}", "{% for t in turns %}{% endfor %}{% for t in turns %}{% endfor %}", "{% for t in turns %}{{ t.__class__ }}{% endfor %}", "{{ first }}{% for t in turns %}{% endfor %}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad, ())


def test_escapes_are_reversible():
    rng = random.Random(0)
    bits = ["<", "|", "s", ">", *chat.CONTROLS, chat.ESCAPE, "-", "a"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))
        safe = chat.escape(text, chat.CONTROLS)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "</s>ok", 5), (1, 0, "user", None, 5), (1, 2, "assistant", "x\n" * 3000, 5), (2, 0, "system", "", 5), (2, 0, "system", "", 5), (None, None, None, "a", 5), (3, 1, "assistant", "b", 5), (3, 1, "assistant", "a", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\n</s>ok\nassistant\n" + "x\n" * 3000 + "\n") and got[1].loss_sha256 == sha("</s>ok" + "x\n" * 3000)
    assert got[1].loss_chars == 6006 and got[2].n_turns == 2 and got[2].loss_sha256 == sha("")
    assert got[3].turns_sha256 == sha("assistant\na\nassistant\nb\n") and got[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home<li>News</ul></nav>
<div class="ad-banner">buy</div><div id="cookie-notice">cookies!</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
  text<br>and on<p>Two &lt;x&gt; &nbsp; z<script>var a="</p>";</script><form><label>name</label></form><aside>side</aside><ul><li>item a<li>item b</ul></article>
<section id="comments"><p>nice post</section></main><div hidden>secret</div><footer>foot</footer></body></html>"""


def test_page_structure():
    assert [t for t, k in extract.blocks_of(PAGE) if k == extract.KEPT] == ["Title & more", "One bold text and on", "Two <x> z", "item a", "item b"]


def test_repeated_boilerplate_without_article():
    pages = [f"<body><div>Welcome to the best site of all the world</div><p>unique words number {i} in page {i * 7} here</p><div>all rights kept by us since long ago</div></body>" for i in range(6)]
    assert extract._texts([extract.blocks_of(p) for p in pages]) == [f"unique words number {i} in page {i * 7} here" for i in range(6)]


def test_repeated_boilerplate_inside_article():
    rng = random.Random(1)
    words = [[f"w{rng.randint(0, 9999)}" for _ in range(60)] for _ in range(5)]
    bodies = [" ".join(w) for w in words]
    near = [" ".join(words[0][:k] + ["edited"] + words[0][k + 1:]) for k in (20, 30, 40)]
    texts = bodies + near + [bodies[0]]
    pages = [f"<body><aside>advert number {i}</aside><article><p>{t}</p><div>read also our ten best stories of this week</div></article></body>" for i, t in enumerate(texts)]
    assert extract._texts([extract.blocks_of(p) for p in pages]) == texts
    assert extract._texts([extract.blocks_of(p) for p in pages[:2]]) == [f"{t}\nread also our ten best stories of this week" for t in texts[:2]]


def test_repeats_are_counted_over_the_whole_host(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 99999)}" for _ in range(30)) for _ in range(600)]
    notice = "<div>read also our ten best stories of this week</div>"
    rows = [(i, f"http://h/{i}", f"<body><article><p>{t}</p>{notice if i % 20 == 0 else ''}</article></body>") for i, t in enumerate(texts)]
    rows += [(1000 + i, f"http://h/m{i}", f"<body><article><p>{texts[1]}</p></article></body>") for i in range(100)]
    got = {r.page_id: r.text for r in extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(texts)) | {1000 + i: texts[1] for i in range(100)}


def test_hosts_of_all_sizes_go_one_way(spark):
    """What is cut does not depend on how many pages are compared at once: notices on three of a host's pages, loose or kept elsewhere."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randint(0, 99999)}" for _ in range(30)) for _ in range(27)]
    notice = [" ".join(f"n{k}{c}" for c in "abcdefghij") for k in range(9)]
    pages = [f"<body><article><p>{t}</p>{f'<p>{notice[i % 9]}</p>' if i < 9 else f'<div>{notice[i % 9]}</div>'}</article></body>" for i, t in enumerate(texts)]
    want = dict(enumerate(extract._texts([extract.blocks_of(p) for p in pages])))
    assert want == {i: t if i >= 9 else f"{t}\n{notice[i]}" for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for cell in (3, 8, 128):
        assert {r.page_id: r.text for r in extract.extract_text(df, cell).collect()} == want


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(0)
    page = np.repeat(np.arange(8), 40)
    tokens = rng.integers(0, 50, len(page))
    for p in (0, 2, 5):
        tokens[p * 40 + 3: p * 40 + 12] = np.arange(100, 109)
    for p in (1, 3):
        tokens[p * 40 + 20: p * 40 + 28] = np.arange(200, 208)
    want = np.zeros(len(page), bool)
    runs = {}
    for i in range(len(page) - 5):
        if page[i] == page[i + 5]:
            runs.setdefault(tuple(tokens[i: i + 6]), []).append(i)
    for places in runs.values():
        if len({page[i] for i in places}) >= 3:
            for i in places:
                want[i: i + 6] = True
    assert want.sum() == 27 and (extract.repeated(tokens, page) == want).all()


PAGES_OF_TAGS = [lambda n: "<a title='" + '"' * n, lambda n: "<a b" * n, lambda n: '<a b="' * n + ">", lambda n: "<p>" + "<b>" * n + "</i><div></div>" * n, lambda n: '<a "<b "' * n + ">",
                 lambda n: "<!--" * n, lambda n: "<![CDATA[" * n, lambda n: "<div>" * n + "x", lambda n: "</p>" * n, lambda n: "<x" + '"<b>"' * n, lambda n: "<ul>" + "<li><b>" * n,
                 lambda n: '<a "><' * n, lambda n: "<p>" * n + "<li>" * n, lambda n: "&lt;" * n, lambda n: "<dl><dt><dl>" + "<b>" * n + "<dt></dt>" * n,
                 lambda n: "<table><tr><td><table>" + "<b>" * n + "<td></td>" * n, lambda n: "<ul><li><ul>" + "<i>" * n + "<li></li>" * n, lambda n: "<div><p><i>" * n + "</p>" * n,
                 lambda n: "<table><tr><td>" * n + "<td>" * n, lambda n: "<select>" + "<b>" * n + "<option>" * n]


@pytest.mark.parametrize("kind", range(len(PAGES_OF_TAGS)))
def test_tags_take_linear_time(kind):
    """Eight times the tags take far less than the 64 times of a quadratic walk."""
    import time

    def took(n):
        page = PAGES_OF_TAGS[kind](n)
        begun = time.process_time()
        extract.blocks_of(page)
        return time.process_time() - begun

    small = min(took(8_000) for _ in range(2))
    assert took(64_000) < 24 * small + 0.5


def test_open_elements_end_where_they_should():
    """Ends of elements that tags imply, inside and outside the boundaries of theirs."""
    texts = lambda page: [t for t, k in extract.blocks_of(page) if k != extract.DROPPED]
    assert texts("<article><ul><li class=ad>x<li>a<ul><li class=ad>y<li>b</ul>c</ul></article>") == ["a", "b", "c"]
    assert texts("<article><dl><dt class=ad>x<dd>a<dl><dt>b<dd class=ad>y</dl>c</dl></article>") == ["a", "b", "c"]
    assert texts("<article><table><tr><td class=ad>x<table><tr><td>y</table>y<td>a<tr><th>b</table></article>") == ["a", "b"]
    assert texts("<article><p class=ad>x<b>x<div>a</div><p>b</article>") == ["a", "b"]
    assert texts("<article><p class=ad>x<b><span>y</b>z</p>a</article>") == ["a"]


def test_repeated_text_of_articles_stays(spark):
    """Headlines and paragraphs that many articles share stay; a bare box that they share goes."""
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randint(0, 99999)}" for _ in range(30)) for _ in range(300)]
    line = "this very sentence stands in each of these articles here"
    rows = [(i, f"http://{'h' if i < 8 else 'large'}/{i}", f"<main><h1>{line} as a headline</h1><article><p>{t}</p><p>{line}</p><ul><li>{line} too</ul><div>read also our ten best stories of this week</div></article></main>") for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{line} as a headline\n{t}\n{line}\n{line} too" for i, t in enumerate(texts)}


def test_class_names_and_teasers():
    long = " ".join(f"word{i}" for i in range(60))
    texts = lambda page: [t for t, k in extract.blocks_of(page) if k != extract.DROPPED]
    assert texts('<article><p class="ad-hoc">a</p><div class="menu-card">b</div><section class="social-policy">c</section><div class="ad-box">x</div></article>') == ["a", "b", "c"]
    assert texts('<p>a</p><div class="kommentare">x</div><div id="Seitenleiste">x</div><div class="werbung">x</div><div class="share-buttons">x</div>') == ["a"]
    assert texts(f"<p>{long}</p><article>teaser</article>") == [long, "teaser"]
    assert texts(f"<p>less</p><article>{long}</article>") == [long]
    assert texts('<p title="a > b">x</p><p title="open>y</p>') == ["x", "y"]


def test_extract_edge_cases(spark):
    rows = [(1, "http://h/a", PAGE, "x"), (2, None, None, "x"), (None, "http://h/b", "", "x"), (1, "http://h/a", PAGE, "x"), (3, "bad", "<p>a < b &unknown; <b", "x"), (4, "http://u@h:80/c", "x" * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract.extract_text(df).collect()
    assert len(got) == 6 and {r.page_id: r.n_chars for r in got}[2] == 0 and {r.page_id: r.text for r in got}[3] == "a < b &unknown;"
    assert extract.extract_text(df.limit(0)).count() == 0
