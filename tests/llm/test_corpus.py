import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueloom.llm import decontamination as DC
from cueloom.llm import html_extraction as HX
from cueloom.llm import packing as PK
from cueloom.llm import queries as Q
from cueloom.llm.html_dom import blocks, parse
from cueloom.llm.quotation import link_quotations, read_messages, reply_links
from tests.llm import fixtures as X
from tests.oracle import assert_same, connect, rows_of

# ---- packing


def test_tournament_is_first_fit():
    rng = random.Random(1)
    for n in (1, 2, 7, 33):
        lengths = [rng.randint(1, 60) for _ in range(n)]
        room: list[int] = []
        want: list[list[int]] = []
        for k in sorted(range(n), key=lambda k: (-lengths[k], k)):
            for b, free in enumerate(room):
                if free >= lengths[k]:
                    break
            else:
                b = len(room)
                room.append(64)
                want.append([])
            room[b] -= lengths[k]
            want[b].append(k)
        assert PK.first_fit_decreasing(lengths, 64) == want


def test_plans_cover_without_padding():
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 30))]
        seqs = PK.plan_group(lengths, 64)
        seen = defaultdict(list)
        for s in seqs:
            total = sum(n for _, _, n in s)
            assert 0 < total <= 64 and total & (total - 1) == 0
            for k, a, n in s:
                seen[k].append((a, n))
        for k, n in enumerate(lengths):
            at = 0
            for a, m in sorted(seen[k]):
                assert a == at
                at += m
            assert at == n


def packed(df):
    pieces = defaultdict(list)
    for r in df.collect():
        pieces[r.sequence_id].append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 2048
    return pieces


def test_packing_round_trip(spark):
    given = X.rows() + [(960, "a <|endoftext|> b"), (961, "  \n\n  tabs\t\t"), (962, " " * 50_000)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packed(PK.pack_documents(X.clashing(X.documents(spark, given)), group_chunks=16))
    got = defaultdict(list)
    for own in pieces.values():
        for r in own:
            got[r.doc_id].append((r.start, r.length, np.frombuffer(r.ids, dtype="<u4").tolist(), r.doc_tokens))
    for i, text in dict(given).items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        copies = sum(j == i for j, _ in given)
        assert sum(x[1] for x in got[i]) == copies * len(ids)
        for start, n, part, total in got[i]:
            assert part == ids[start : start + n] and total == len(ids)
    fills = [sum(r.length for r in own) for own in pieces.values()]
    padding = sum(0 if f & (f - 1) == 0 else 2048 - f for f in fills)
    assert padding <= 0.01 * sum(fills)
    assert PK.pack_documents(X.empty(spark)).count() == 0
    one = PK.pack_documents(X.documents(spark, [(1, None)])).collect()
    assert [(r.length, r.doc_tokens, r.offset) for r in one] == [(1, 1, 0)]


def test_packing_query(spark, sf):
    got = Q.op9_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got.collect():
        ids = np.array(t.encode(docs[r.doc_id], add_special_tokens=False).ids + [1], dtype="<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens


# ---- decontamination

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_hits(text, items, size=10):
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lower(text or ""))]
    hit, found = set(), set()
    for i, t in items:
        own = _WORD.findall(lower(t or ""))
        n = min(size, len(own))
        wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(w for w, _, _ in words[k : k + n]) in wins:
                hit.update(range(k, k + n))
                found.add(i)
    return len(words), hit, sorted(found), words


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "short One!"), (3, None), (4, " ?! "), (5, "quick brown fox jumps over the lazy dog again and"), (6, "ß Élan"), (5, "zebra")]


@pytest.mark.parametrize("most", [20_000_000, 60])
def test_hits_equal_brute_force(spark, most):
    rng = random.Random(4)
    vocab = "the quick brown fox jumps over lazy dog again and today short one élan ß zebra".split()
    given = X.rows()[:60] + [(1000 + k, " ".join(rng.choice(vocab) + rng.choice(["", ",", "-"]) for _ in range(60)) + rng.choice(["", " THE QUICK brown-fox; jumps over the lazy dog again and again today!"])) for k in range(30)]
    given += [(2000, "short one"), (2001, "shortone"), (2002, "x short one short one y"), (2003, "Élan"), (2000, "short one")]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("spans", F.lit("clash"))
    got = DC.find_contamination(X.clashing(X.documents(spark, given)), bench, max_chars=most).collect()
    assert len(got) == len(given)
    texts = dict(given)
    for r in got:
        n, hit, found, words = brute_hits(texts[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), found)
        covered = {k for s in r.spans for k in range(s.first_word, s.first_word + s.n_words)}
        assert covered == hit
        raw = (texts[r.doc_id] or "").encode()
        for s in r.spans:
            a, b = words[s.first_word], words[s.first_word + s.n_words - 1]
            assert lower(raw[s.byte_from : s.byte_to].decode()) == lower(texts[r.doc_id])[a[1] : b[2]]
    clean = DC.drop_contaminated(X.documents(spark, given), bench, max_chars=most)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in given if not brute_hits(t, ITEMS)[1])


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 and r.item_ids == [] for r in DC.find_contamination(X.documents(spark), none).collect())
    assert DC.find_contamination(X.empty(spark), none).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(Q.QUERIES[name](spark, sf), connect(sf), Q.ORACLE_SQL[name])


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style></head><body class="has-sidebar"><header><div>Site</div><nav><a href=/>Home {0}</a></nav></header>
<div class="cookie-notice">We use cookies</div><div id="wrap"><div class="content"><h1>Title&nbsp;&amp; more {0}</h1><p>First <b>para <a href=x>link</a></b>   text {0}.<p>Second&#33; para{0}<br>line two<ul><li>one{0}<li>two{0}</ul>
<div class="ad">Buy {0}!</div><form><input><p>Subscribe {0}</p></form><script>if (a<b) document.write("<p>no</p>")</script><p>3 < {0} &lt;ok&gt;</p><section class="comments"><p>Reader {0}</p></section></div>
<aside><p>Side {0}</p></aside></div><footer>&copy; {0}</footer></body></html>"""
TEXT = "Title & more {0}\nFirst para link text {0}.\nSecond! para{0} line two\none{0}\ntwo{0}\n3 < {0} <ok>"


def test_wrappers(spark):
    rows = [(k, f"https://Host{k % 2}.org/{k}", PAGE.format(k)) for k in range(30)]
    rows += [(100, None, PAGE.format(100)), (101, "https://host0.org/x", None), (102, "https://host0.org/y", ""), (103, "https://host1.org/z", "<article><h1>Other</h1><p>layout</p></article><div>menu</div>"), (0, *rows[0][1:])]
    rows += [(200 + k, f"https://tpl.org/{k}", f"<body><div class=main><p>Share this page</p><p>Own text {k}</p></div><div>foot</div></body>") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("wrapper", F.lit("clash")).withColumn("host", F.lit("clash"))
    for p in (HX.WrapperParams(), HX.WrapperParams(broadcast_bytes=0)):
        got = sorted((r.page_id, r.text) for r in HX.extract_pages(df, p).collect())
        want = sorted([(k, TEXT.format(k)) for k in [*range(30), 0, 100]] + [(101, ""), (102, ""), (103, "Other\nlayout")] + [(200 + k, f"Own text {k}") for k in range(8)])
        assert got == want
    assert HX.extract_pages(df.limit(0)).count() == 0


def test_tree_matching():
    a = HX.fold_tree([parse("<body><div><p>x<p>y</div><ul><li>1</ul></body>")])
    b = HX.fold_tree([parse("<body><div><p>z</div><table><tr><td>q</table><ul><li>2<li>3</ul></body>")])
    assert HX.tree_match(a, a)[0] == 6 and HX.tree_match(a, b)[0] == 6 and HX.tree_match(a, HX.fold_tree([parse("<p>x")]))[0] == 1


@pytest.mark.parametrize(
    ("page", "text"),
    [("<p", ""), ("<!-- x", ""), ("a<1b", "a<1b"), ("<div><p>x</div>y", "x\ny"), ("<script>x", ""), ("plain", "plain"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<p>a <span hidden>b</span>c", "a c"), ("<b><p>x</b>y</p>z", "xy\nz"), ("<p>&am &#x41;", "&am A"), ("<div>" * 5000 + "deep", "deep")],
)
def test_odd_markup(page, text):
    assert HX.extract(page, None) == text
    assert "\n".join(t for _, t in blocks(parse(page))) == text


def test_pages_of_the_test_data(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html

    for r in Q.op8_html_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# ---- quotations

TALK = [
    (1, 0, "user", "Hello there\nHow are you today?"),
    (1, 1, "assistant", "> How are you   TODAY?\nFine."),
    (1, 2, "user", "> > How are you today?\n> Fine.\nGood to hear."),
    (1, 3, "user", ">>> How are you today?\n\nOff topic"),
    (1, 4, "user", "> never said\nAlone"),
    (1, 5, "user", None),
    (1, 6, "user", "> Hello there\n> How are you today?\nwhole"),
    (2, 0, "user", "Fine."),
    (2, 1, "user", "> Good to hear.\nother conversation"),
    (2, 2, "user", "> Fine.\n\n> Fine.\n"),
    (2, 2, "user", "> Fine.\n\n> Fine.\n"),
    (None, 0, "user", "> Fine."),
    (3, None, "user", "Fine."),
    (3, 0, "user", ""),
]


def test_quotations(spark):
    df = spark.createDataFrame(TALK, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in link_quotations(df.withColumn("depth", F.lit("clash")).withColumn("source", F.lit(1))).collect()}
    links = {k: (r.reply_to, r.thread_turn, r.depth) for k, r in got.items()}
    assert links[1, 1] == (0, 0, 1) and links[1, 2] == (1, 0, 2) and links[1, 3] == (0, 0, 1) and links[1, 4] == (None, 4, 0) and links[1, 6] == (0, 0, 1)
    assert links[2, 1] == (None, 1, 0) and links[2, 2] == (0, 0, 1) and links[None, 0] == (None, 0, 0)
    assert got[1, 2].text == "Good to hear." and got[1, 3].text == "Off topic" and got[1, 5].text is None and got[1, 2].max_level == 2 and got[2, 2].n_quotes == 2
    assert link_quotations(df).count() == len(TALK) and link_quotations(df.limit(0)).count() == 0


def test_quotations_equal_sql(spark, tmp_path):
    rng = random.Random(7)
    lines = ["alpha beta", "gamma", "delta  epsilon", "Zeta", " \t", "a > b", "ta\t\tb\r", "x \r"]
    rows = list(TALK[:6] + TALK[7:10])
    for c in range(10, 16):
        for t in range(12):
            rows.append((c, t, "user", "\n".join(rng.choice(["", "> ", ">> ", "> > "]) + rng.choice([*lines, ""]) for _ in range(rng.randint(1, 5)))))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    assert rows_of(link_quotations(df).toArrow()) == rows_of(con.sql(Q.ORACLE_SQL["op3_quotation_linking"]).to_arrow_table())


def test_quotations_run_without_python(spark, sf):
    messages = spark.read.parquet(f"{sf}/conversations.parquet")
    # the result's own plan begins at a checkpoint, so what ran before is looked at too
    for df in (read_messages(messages), reply_links(read_messages(messages)), link_quotations(messages)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_every_layout_of_a_hot_host_has_its_wrapper(spark):
    """The constants of a layout are learnt from all its pages, however few of the host's they are."""
    shapes = [
        (140, "<body><div class=a><p>Notice of a</p><p>Text {0}</p></div></body>"),
        (50, "<body><div class=b><p>Notice of b</p><p>Text {0}</p></div></body>"),
        (10, "<body><div class=c><p>Text {0}</p><p>Notice of c</p></div></body>"),
    ]
    rows = [(1000 * s + k, f"https://hot.org/{s}/{k}", page.format(f"{s} {k}")) for s, (n, page) in enumerate(shapes) for k in range(n)]
    rows += [(9000 + k, "https://hot.org/copy", shapes[0][1].format("0 0")) for k in range(50)]
    got = {r.page_id: r.text for r in HX.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = {1000 * s + k: f"Text {s} {k}" for s, (n, _) in enumerate(shapes) for k in range(n)}
    assert got == want | dict.fromkeys(range(9000, 9050), "Text 0 0")


ORDINARY = '<h2 id="social-policy">Policy {0}</h2><section id="discussion"><p>Discussed {0}</p></section><div class="alert"><p>Warned {0}</p></div><p>By <span class="share">half {0}</span></p>'


@pytest.mark.parametrize("outer", ["article", "main"])
def test_ordinary_words_of_a_class_or_id_drop_nothing_in_the_article(outer):
    page = f"<body><div class=related>Other</div><{outer}>{ORDINARY}<div class=ads>Buy</div></{outer}></body>"
    assert HX.extract(page.format(1), None) == "Policy 1\nDiscussed 1\nWarned 1\nBy half 1"


def test_ordinary_words_drop_nothing_in_the_region(spark):
    long = "<p>" + "Words of the text {0}. " * 20 + "</p>"
    page = f"<body><div class=story>{long}{ORDINARY}<div class=notice>Same for all</div><div class=sidebar>Side {{0}}</div></div><div class=related>Next {{0}}</div></body>"
    df = spark.createDataFrame([(k, f"https://story.org/{k}", page.format(k)) for k in range(20)], "page_id bigint, url string, html string")
    for r in HX.extract_pages(df).collect():
        k = r.page_id
        assert r.text.split("\n")[1:] == [f"Policy {k}", f"Discussed {k}", f"Warned {k}", f"By half {k}"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>" + "\u0130" * 20 + "</p><script>a</SCRIPT >kept<p>more", "\u0130" * 20 + "\nkept\nmore"),
        *((f"<p>a</p><{tag}>b<p>c</p>", "a\nb\nc") for tag in ("svg", "math", "noscript", "template", "iframe")),
        ("<p>a</p><svg>x</svg>b<svg><p>c", "a\nb\nc"),
        ("<p>a</p><style>b<p>c", "a"),
    ],
)
def test_text_behind_raw_elements(page, text):
    assert HX.extract(page, None) == text


def test_items_without_an_id_hit(spark, tmp_path):
    import duckdb

    items = [(1, "one two three four"), (None, "five six seven eight"), (None, "nine ten"), (2, "nine ten")]
    given = [(1, "x one two three four y"), (2, "five six seven eight"), (3, "a nine ten b five six seven eight"), (4, "clean")]
    docs, bench = X.documents(spark, given), spark.createDataFrame(items, "item_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    bench.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = Q.op10_decontamination(spark, str(tmp_path))
    assert rows_of(got.toArrow()) == rows_of(con.sql(Q.ORACLE_SQL["op10_decontamination"]).to_arrow_table())
    for most in (20_000_000, 60):
        assert {r.doc_id: r.item_ids for r in DC.find_contamination(docs, bench, max_chars=most).collect()} == {1: [1], 2: [None], 3: [2, None], 4: []}
        assert [r.doc_id for r in DC.drop_contaminated(docs, bench, max_chars=most).collect()] == [4]


def test_very_long_blanks_are_encoded(spark):
    """Runs of white space beyond the stack of the ranks' pattern give the ids of the tokenizer itself."""
    enc = PK.BpeIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x" + " " * 1_000_000 + "y", "\n" * 1_000_000, " " * 99_999 + "x"):
        assert enc.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    got = PK.pack_documents(X.documents(spark, [(1, "x" + " " * 1_000_000 + "y"), (2, "short")])).collect()
    assert {r.doc_id for r in got} == {1, 2}


def test_only_the_emptiest_sequence_is_cut():
    rng = random.Random(4)
    lengths = [min(2047, 1 + int(rng.expovariate(1 / 400))) for _ in range(2000)]  # as documents are: many short ones
    plan = PK.plan_group(lengths, 2048)
    fills = [sum(n for _, _, n in seq) for seq in plan]
    pieces = sum(len(seq) for seq in plan)
    padding = sum(2048 - f for f in fills if f & (f - 1))
    assert sum(fills) == sum(lengths) and max(fills) <= 2048
    assert pieces <= len(lengths) + len(plan) and padding < 0.005 * sum(lengths)


def test_sequences_of_first_fit_are_filled():
    rng = random.Random(5)
    for lengths in ([1365] * 40, [2047, 1500, 700, 3], [2048, 2048], [], [min(2048, 1 + int(rng.expovariate(1 / 400))) for _ in range(1000)]):
        plan = PK.plan_group(lengths, 2048)
        fills = [sum(n for _, _, n in seq) for seq in plan]
        assert sorted(fills, reverse=True) == [2048] * (sum(lengths) // 2048) + [1 << b for b in range(10, -1, -1) if sum(lengths) >> b & 1]
        # the fullest sequences of first fit stay whole; each sequence cuts one item at most
        rest = [n for n in lengths if n < 2048]
        bins = sorted((sorted(rest[k] for k in b) for b in PK.first_fit_decreasing(rest, 2048)), key=sum, reverse=True) if rest else []
        own = [{(k, n) for k, a, n in seq if n == lengths[k]} for seq in plan if len(seq) > 1 or seq[0][2] < 2048]
        for b in bins[: sum(rest) // 2048]:
            assert any(not Counter(b) - Counter(n for _, n in seq) for seq in own)
        assert sum(len(seq) for seq in plan) <= len(lengths) + len(plan)
