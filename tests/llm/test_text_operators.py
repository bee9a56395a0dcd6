"""Chat formatting, BPE, token counts, token files, HTML and language ID: against libraries, round trips and held-out rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skilltide.llm import byte_bpe, chat_format, decontaminate, html_text, jaccard_join, language_id, token_counts, token_files
from skilltide.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import rows_by_name

SF = "/root/testdata/sf0.001"
BPE, JSON, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "a", "It's l'eau don't.", "x" * 3000, "<|endoftext|> a<|endoftext|>", "  \n\n tab\tend ", "日本語。テスト, ok.", "É, été. İstanbul. ﬁ 12.5, 3.", "a", "😀 ** !!"]


def docs(spark, texts, extra=False):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    return df if extra else df.drop("n_tokens")


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queries_with_sql(spark, duck):
    for name, sql in ORACLE_SQL.items():
        found = QUERIES[name](spark, SF)
        assert rows_by_name(found.columns, found.collect()) == duck(SF, sql), name


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_segment_tree_equals_tiktoken(texts):
    bpe, library = byte_bpe.codec(BPE), tik()
    ids, counts = bpe.encode(texts)
    ends = np.cumsum([0, *counts])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids, counts) == [t.encode() for t in texts]


def test_long_pieces_and_forgetting():
    random.seed(4)
    bpe, library = byte_bpe.ByteBPE(BPE, held=50), tik()
    for n in (1, 2, 3, 16, 17, 129, 4000):
        text = "".join(random.choice("aabcdeé") for _ in range(n))
        assert bpe.encode([text, text + " b"])[0].tolist() == library.encode_ordinary(text) + library.encode_ordinary(text + " b")


def test_bpe_round_trip(spark):
    both = byte_bpe.encode(docs(spark, ODD, True).withColumnRenamed("n_tokens", "decoded"), BPE)
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(both, BPE).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    rows = {r.doc_id: r for r in byte_bpe.digests(docs(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        ids = tik().encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digests(docs(spark, [])).count() == 0


@pytest.mark.parametrize("known", [0, 3, 200_000])
def test_token_counts(spark, monkeypatch, known):
    monkeypatch.setattr(token_counts, "FREQUENT", known)
    library, said = Tokenizer.from_file(JSON), [*ODD, "clash of names " * 400, "one one two"]
    clash = docs(spark, said, True).selectExpr("*", "doc_id AS row", "text AS rare", "1 AS sum", "doc_id AS `a.b`")
    found = token_counts.count_tokens(clash.unionByName(clash), JSON, limit=5)
    assert found.columns == ["doc_id", "row", "rare", "sum", "a.b", "n_bytes", "n_tokens", "over_limit"]
    rows = found.collect()
    assert len(rows) == 2 * len(said)
    for r in rows:
        t = said[r.doc_id]
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit, r.row, r.rare) == (n, len((t or "").encode()), n > 5, r.doc_id, t)
    assert token_counts.count_tokens(docs(spark, []), JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbzé.,'* \n\tİ1<|>ß́“”!- 中", max_size=40), max_size=5))
def test_word_ids_equal_the_library(texts):
    held = token_files._held.setdefault(WORDS, token_files.WordIds(WORDS))
    ids, counts = held.encode([t.encode() for t in texts])
    ends = np.cumsum([0, *counts])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [held.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=70), st.integers(7, 12))
def test_code_lengths(counts, limit):
    lengths = token_files.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and (len(counts) == 1 or sum(2.0 ** -int(x) for x in lengths) == 1.0)
    if limit == 12:  # long enough that the limit does not bind for most: compare with plain Huffman
        import heapq

        heap, total = sorted(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert len(counts) == 1 or int((lengths * np.array(counts)).sum()) >= total


def test_packing():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000), 900)
    n = np.bincount(ids)
    book = token_files.CodeBook.of(np.flatnonzero(n), n[np.flatnonzero(n)])
    blocks = [(*token_files.pack(part, *book.encoder()), len(part)) for part in (ids[:1], ids[1:129], ids[129:])]
    assert np.concatenate(token_files.unpack(blocks, book.decoder())).tolist() == ids.tolist()
    assert sum(len(p) for p, _, _ in blocks) * 8 < 5000 * 10 + 100


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 50)
    texts = ODD * 3
    ids, dtype = token_files.tokenize(docs(spark, texts).repartition(3), WORDS)
    path = token_files.write(ids, dtype)
    other = spark.newSession()  # all that a reader gets is the path
    assert other.read.parquet(f"{path}/blocks").count() > 3
    rows = token_files.with_starts(token_files.read(other, path), path).orderBy("doc_id").collect()
    sums = {r.doc_id: r.ids_crc32 for r in token_files.read_checksums(other, path).collect()}
    library, at = Tokenizer.from_file(WORDS), 0
    for r, t in zip(rows, texts, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        assert sums[r.doc_id] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    ids, dtype = token_files.tokenize(docs(spark, []), WORDS)
    assert token_files.read(spark, token_files.write(ids, dtype)).count() == 0


def test_token_files_of_odd_ids(spark):
    rows = spark.createDataFrame([(None, "b a"), (3, "x"), (3, None), (3, "x"), (1, "y" * 70_000)], "doc_id long, text string")
    found = token_files.with_starts(token_files.read(spark, path := token_files.write(*token_files.tokenize(rows, WORDS))), path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 3, 3, 3] and sorted(r.n_tokens for r in found[2:]) == [1, 2, 2]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found[:-1]]).tolist()


def thue_morse(sign=b"a"):
    """1,024 letters; with its complement a pair that any polynomial hash modulo 2**64 maps to one value."""
    for _ in range(10):
        sign += bytes(97 + 98 - c for c in sign)
    return sign.decode()


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(b"a"), thue_morse(b"b")
    held, library = token_files.WordIds(WORDS), Tokenizer.from_file(WORDS)
    ids, counts = held.encode([a.encode(), b.encode()])
    assert ids[: counts[0]].tolist() == library.encode(a, add_special_tokens=False).ids and ids[counts[0] :].tolist() == library.encode(b, add_special_tokens=False).ids
    groups = jaccard_join.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in groups} == {1: 1, 2: 2, 3: 1}
    bench = spark.createDataFrame([(9, a)], "item_id long, text string")
    hits = decontaminate.contamination(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), bench).collect()
    assert {r.doc_id: r.n_hit for r in hits} == {1: 1, 2: 0}


def test_units_with_colliding_hashes(monkeypatch):
    real = token_files.span_hash
    monkeypatch.setattr(token_files, "span_hash", lambda data, starts, ends: np.where(ends - starts > 8, real(data, starts, ends) % np.uint64(5), real(data, starts, ends)))
    held, library = token_files.WordIds(WORDS), Tokenizer.from_file(WORDS)
    texts = ["alphabetagamma betagammadelta", "internationalization of the internationally known", "short word", "", "alphabetagamma betagammadelto a b c"]
    for _ in range(2):
        ids, counts = held.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_are_compared_by_bytes():
    block = decontaminate.Block(np.zeros((2, 13), np.uint64), np.array([2, 1]), [["1"], ["2"]], np.array([0, 2]), np.frombuffer(b" red car blue ", np.uint8), np.array([1, 5, 9]), np.array([4, 8, 13]))
    found = decontaminate.words([b"a red  car", b"a car red", b"Blue"], decontaminate.ALNUM)
    assert block.equal(np.array([0, 0, 1]), found, np.array([1, 3, 6])).tolist() == [True, False, True]


def test_chat_layouts_and_escapes(spark):
    texts = ["<|im_end|>", "<\\|im_start|>", "a<|b\\|c", "", None, "<\\\\|", "two\nlines"]
    rows = [(7, i, "assistant" if i % 2 else "us\ner", t, "x") for i, t in enumerate(texts)] + [(None, 0, None, "n", "x"), (8, None, "assistant", "a", "x"), (8, 1, "assistant", "a", "x"), (8, 1, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.canonical_turns(df))).collect()}
    assert [(t.role, t.text) for t in back[7].turns] == [("assistant" if i % 2 else "us\ner", t or "") for i, t in enumerate(texts)]
    assert back[7].loss_text == "".join(t or "" for t in texts[1::2]) and len(back[8].turns) == 3 and back[None].turns[0].role == ""
    assert back[7].formatted.count("<|im_start|>") == len(texts)
    messages = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")]), (2, None)], "id int, messages array<struct<role:string,content:string>>")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.canonical_turns(messages, "id").collect()}
    assert got == {1: [("user", "hi"), ("assistant", "yo")], 2: []}
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical_turns(messages.select("id"), "id")
    assert chat_format.canonical_turns(df.where("false")).count() == 0


def test_chat_json_records(spark):
    records = ['{"messages":[{"role":"user","content":"q"}],"other":1}', '{"instruction":"i","input":"more","output":"o"}', '{"instruction":"i","output":"o"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"system":"s","prompt":"p","response":"r"}', "{broken", None, '{"unknown":1}']
    rows = chat_format.canonical_turns_json(spark.createDataFrame(list(enumerate(records)), "id int, record string"), "id", "record").orderBy("conv_id").collect()
    assert [r.layout for r in rows] == ["messages", "instruction with input", "instruction", "conversations", "system, prompt and response", None, None, None]
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "i\nmore"), ("assistant", "o")] and rows[3].turns[1].role == "assistant"


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="ad">Buy</div><div id="main"><h1>Title &amp; more</h1><p>First <b>bold<br>paragraph with enough words to stand out from all the rest of the page.<p>Second&nbsp;one &lt;tag&gt; with a <a href="x">link</a> in the text, and more of it.
<ul><li>item one</li><li>item two</li></ul></div><div class="comments"><p>Reader says</p></div><aside>side</aside><footer>&copy; me"""


def test_html(spark):
    text = html_text.extract_text(PAGE)
    assert text.split("\n\n") == ["Title & more", "First bold paragraph with enough words to stand out from all the rest of the page.", "Second one <tag> with a link in the text, and more of it.", "item one", "item two"]
    odd = [None, "", "no tags at all", "<p>", "<<>><p x='>a", "<script>only", "<div>" * 3000 + "deep", "<!-- open"]
    rows = html_text.extract(spark.createDataFrame(list(enumerate(odd)), "page_id int, html string")).orderBy("page_id").collect()
    assert [r.text for r in rows][:4] == ["", "", "no tags at all", ""] and rows[6].text == "deep" and all(r.n_chars == len(r.text) for r in rows)


def paragraphs(first, n):
    """n paragraphs of 40 words, and their texts."""
    texts = [" ".join(f"word{(first * 1000 + i * 40 + j) * 7919 % 9973}" for j in range(40)) + "." for i in range(n)]
    return "".join(f"<p>{t}</p>" for t in texts), texts


LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(12)) + "</ul>"


def test_html_of_several_parts():
    (a, x), (b, y), (c, z) = paragraphs(1, 5), paragraphs(2, 5), paragraphs(3, 4)
    pages = {
        f"<body><h1>Title</h1><div>{a}</div><div>{b}</div></body>": ["Title", *x, *y],
        f"<body>{LINKS}<h1>Title</h1><p>By someone</p><div>{a}</div><p>Short.</p>{LINKS}<div>{b}</div><div>{c}</div>{LINKS}</body>": ["Title", "By someone", *x, "Short.", *y, *z],
        f"<body><main><h1>Title</h1><article>{a}</article><article>{b}</article><article><p>Short end.</p></article></main>{LINKS}</body>": ["Title", *x, *y, "Short end."],
        f"<body>{LINKS}<article><div>{a}</div><p>Short end.</p></article></body>": [*x, "Short end."],
        f"<body><div><div><h1>Title</h1></div><div>{a}</div></div>{LINKS}<div><div>{b}</div></div></body>": ["Title", *x, *y],
        f"<body><div>{a}</div>{y[0]} <b>{y[1]}</b> {y[2]}{LINKS}</body>": [*x, " ".join(y[:3])],
        f"<main><div>{a}</div><p>Short end.</p></main>": [*x, "Short end."],
    }
    for page, wanted in pages.items():
        assert html_text.extract_text(page).split("\n\n") == wanted, page


def test_html_of_parts_beside_each_other():
    (a, x), (b, y), (c, z) = paragraphs(1, 5), paragraphs(2, 3), paragraphs(3, 3)
    pages = {
        f"<body><div>{a}</div><div>{b}</div></body>": x + y,
        f"<body><h1>Title</h1><div>{a}</div></body>": ["Title", *x],
        f"<body><div class=wrap><div>{a}</div>{LINKS}</div></body>": x,
        f"<body><div class=wrap><article>{a}</article>{LINKS}</div></body>": x,
        f"<article>{a}<p class=related>{z[0]}</p><p class=share>{z[1]}</p><p class=notice>{z[2]}</p><p class=ad>Buy</p><p class=share><a href=x>Share</a></p></article>": x + z,
    }
    for page, wanted in pages.items():
        assert html_text.extract_text(page).split("\n\n") == wanted, page


def random_tree(rng, depth):
    """A tree as (tag, parts) with texts and nodes in turn."""
    tags = ["div", "div", "section", "p", "b", "a"] if depth else ["p", "b", "a"]
    tag = rng.choice(tags)
    parts = [" ".join(rng.choice(["word", "longer", "a", "text"]) for _ in range(rng.choice([0, 2, 9, 40]))) for _ in range(rng.randint(1, 2))]
    if tag in ("div", "section") or tag == "p" and depth == 1:
        parts += [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if tag != "p" else [("b", ["bold"])]
    return tag, parts


def written(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>" + "".join(map(written, tree[1])) + f"</{tree[0]}>"


def brute_density(tree, share):
    """Density of a node and sum of its children's, by the formula, each number counted anew."""

    def count(t, chars=lambda x: len("".join(x.split())), node=lambda tag: 0, inside=lambda tag: True):
        if isinstance(t, str):
            return chars(t)
        return node(t[0]) + sum(count(x, chars, node, inside) for x in t[1])

    def link_chars(t, inside=False):
        if isinstance(t, str):
            return len("".join(t.split())) if inside else 0
        return sum(link_chars(x, inside or t[0] == "a") for x in t[1])

    def density(t):
        c, lc = count(t), link_chars(t)
        below = [x for x in t[1] if not isinstance(x, str)]
        tags = max(1, sum(count(x, lambda _: 0, lambda _: 1) for x in below))
        links = max(1, sum(count(x, lambda _: 0, lambda tag: tag == "a") for x in below))
        if not c:
            return 0.0
        ratio = c / max(1, lc) * tags / links
        return c / tags * np.log(max(1.0, ratio) + 1e-9) / np.log(c / max(1, c - lc) * lc + share * c + np.e)

    return density(tree), sum(density(x) for x in tree[1] if not isinstance(x, str))


def test_html_density_equals_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        tree = ("body", [random_tree(rng, 3) for _ in range(rng.randint(1, 4))])
        root = html_text.parse(written(tree))
        order = html_text.measure(root)
        share = root.links / root.chars if root.chars else 0.0

        def check(node, t):
            d, total = brute_density(t, share)
            assert np.isclose(node.density, d) and np.isclose(node.total, total)
            nodes = [x for x in node.parts if not isinstance(x, str)]
            inner = [x for x in t[1] if not isinstance(x, str)]
            assert [n.tag for n in nodes] == [x[0] for x in inner]
            for n, x in zip(nodes, inner):
                check(n, x)

        body = next(n for n in order if n.tag == "body")
        check(body, tree)
        # all blocks that reach the share of the least density on the path are in the text
        best = max(reversed(order), key=lambda n: n.total)
        path = [best]
        while path[-1].tag != "body" and path[-1].parent is not None:
            path.append(path[-1].parent)
        least = html_text.SHARE * min(n.density for n in path)
        got = html_text.extract_text(written(tree))
        for n in order:
            if n.block and n.tag not in ("html", "body") and n not in path and n.density >= least and n.chars:
                assert "".join("".join(html_text.blocks(n)).split()) in "".join(got.split())


def test_html_of_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "<p>a b", "x", 5, "y")] * 2, "page_id int, html string, text string, n_chars int, url string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(rows).collect()] == [(1, "y", "a b", 3)] * 2


def test_html_names_of_wrappers():
    (a, x), (b, y), (c, z) = paragraphs(1, 5), paragraphs(2, 5), paragraphs(3, 1)
    for name in ("class='content has-sidebar'", "class='site no-sidebar'", "class=page-with-comments", "id='related-research'", "class='social-history'", "class=sidebar", "id=comments"):
        assert html_text.extract_text(f"<body><div {name}><article>{a}</article></div></body>").split("\n\n") == x, name
        assert html_text.extract_text(f"<body>{LINKS}<div {name}>{a}</div></body>").split("\n\n") == x, name
    for name in ("has-sidebar", "related-research", "social-history"):
        assert html_text.extract_text(f"<article>{a}<section class='{name}'>{b}</section>{c}</article>").split("\n\n") == x + y + z, name
    for name in ("siteFooter", "cookieNotice", "adBox", "site-footer", "ad_1", "related-posts", "comments", "leftSidebar", "sidebar-content"):
        assert html_text.extract_text(f"<body><article>{a}<div class='x {name}'>{c}</div></article></body>").split("\n\n") == x, name
    assert html_text.extract_text(f"<body><div class=ad>{a}</div><article>{c}</article></body>").split("\n\n") == z
    said = f"<ol class=comment-list><li class=comment><article class=comment-body>{c}</article></ol>"
    assert html_text.extract_text(f"<body><article>{a}</article>{said}</body>").split("\n\n") == x


def test_convolution_equals_brute_force():
    rng = np.random.default_rng(2)
    net = language_id.ByteConvNet(["x", "y", "z"], {w: rng.normal(0, 1, (w, 256, language_id.FILTERS)) for w in language_id.WIDTHS}, rng.normal(0, 1, (3 * language_id.FILTERS, 3)), rng.normal(0, 1, 3))
    windows = rng.integers(0, 256, (5, language_id.LENGTH)).astype(np.uint8)
    found = net.tables().probabilities(windows)
    for row, got in zip(windows, found):
        pooled = []
        for w, f in net.filters.items():
            pooled += [max(sum(f[j, row[p + j], k] for j in range(w)) for p in range(len(row) - w + 1)) for k in range(language_id.FILTERS)]
        z = np.tanh(np.array(pooled)) @ net.dense + net.bias
        assert np.allclose(got, np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_language_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the and of", "en"), (1, "the and of", "en"), (2, "le la les", "fr"), (None, "x", "en"), (3, None, "en"), (4, "y", None)]
    df = spark.createDataFrame([(*r, 1.0, "q", 2) for r in rows], "doc_id long, text string, lang string, score double, lang_pred string, windows int")
    net = language_id.train(df)
    assert net.langs == ["en", "fr"]
    found = language_id.predict(df, net)
    assert sorted(found.columns) == sorted(df.columns) and found.count() == 6 and {r.lang_pred for r in found.where("doc_id = 3").collect()} == {"und"}
    one = language_id.train(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.predict(df.where("text IS NOT NULL"), one).collect()} == {"fr"}


def test_language_id(spark):
    found = QUERIES["op9_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    net = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"), sample=30)
    rows = language_id.predict(docs(spark, [None, "", "123 !", "é", "the of and " * 500]), net).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[3].lang_pred in net.langs and rows[4].lang_pred == "en"
    assert language_id.train(docs(spark, []).selectExpr("doc_id", "text", "text AS lang")) is None
    assert language_id.predict(docs(spark, ["a"]), None).first().lang_pred == "und"
