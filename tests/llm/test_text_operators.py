"""Operators that work text by text, against the libraries or plain versions."""

import hashlib
import random
from collections import Counter

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from nearfield.llm import chat_format, html_text, language_id, piece_codec, queries, token_counts  # noqa: E402
from nearfield.llm.chat_template import TemplateError, compile_template, escape_control, escape_line, fold_block, parse, render, unescape  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, n_tokens bigint"
TEXTS = ["", "  foo bar", " ", "▁x a", "<s>hi</s> <unk>", "a\n\n b", "é日本🙂 x\x00y", "   ", "x" * 5000, "word " * 3000, "▁▁ ▁", "a ", "Hello  world!\t\t  tab", "😀😀", "a b　c"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def random_texts(n=300, seed=5):
    r = random.Random(seed)
    letters = "abcdefgh éñ▁ \n.,;  AB日<|>\\'\"0123😀"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


def test_codec_equals_library(sp):
    codec = piece_codec.CodecTable(piece_codec.model_path(), size=50)
    for t in TEXTS + random_texts():
        want = sp.encode(t, add_bos=True, add_eos=True)
        ids, decoded = codec.encode(t)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
        assert decoded == sp.decode(want)


def test_prefix_counts_equal_library(sp):
    counter = token_counts.CountTable(piece_codec.model_path())
    for t in [*(x for x in TEXTS if len(x) < 100), *random_texts(60, 8), "International misunderstanding, antidisestablishmentarianism 1234567890"]:
        p = counter.prefixes(t)
        want = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert p.every() == want and [p.at(i) for i in range(len(t) + 1)] == want
        for budget in range(p.total + 2):
            assert p.fit(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_prefix_counts_of_long_chunks_are_linear(sp, monkeypatch):
    import time

    r = random.Random(2)
    counter, took, encoded = token_counts.CountTable(piece_codec.model_path()), [], []
    monkeypatch.setattr(counter, "ids", encoded.extend)
    for n in (250_000, 1_000_000):
        t = "".join(r.choice("abcdeinorst") for _ in range(n))
        begun = time.perf_counter()
        p = counter.prefixes(t)
        took.append(time.perf_counter() - begun)
        for i in (1, 2, 700, 4097, 8999, n // 3, n):
            assert p.at(i) == len(sp.encode(t[:i]))
        fit = p.fit(2000)
        assert p.at(fit) <= 2000 and (p.counts[fit + 1 :] > 2000).all()
    assert not encoded  # nothing is encoded
    assert took[1] < 10 * took[0]


def test_prefixes_of_words_that_merge_in_turns(sp):
    counter, r = token_counts.CountTable(piece_codec.model_path()), random.Random(3)
    pieces = [sp.id_to_piece(i).replace(piece_codec.MARK, "") for i in range(300, sp.get_piece_size())]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 7))) for _ in range(400)]
    for t in [*texts, "aaaaaaaaaaaaaaaaaaaaaaa", "ababababababab", "//////////////////", "=" * 70, "0000000000001"]:
        assert counter.prefixes(t).every() == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]


def test_registered_text_queries(spark, sf, sp):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.op8_sentencepiece(spark, sf).collect()}
    counts = {r.doc_id: r for r in queries.op7_token_counts(spark, sf).collect()}
    assert len(got) == len(counts) == len(docs)
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(sp.decode(ids)))
        assert len(sp.encode((t or "")[: counts[d].fit_chars])) <= 4096 and (counts[d].over_limit or counts[d].fit_chars == len(t or ""))
        assert (counts[d].n_bytes, counts[d].n_tokens, counts[d].over_limit) == (len((t or "").encode()), len(ids) - 2, len(ids) - 2 > 4096)


def test_text_operators_on_odd_tables(spark):
    rows = [(1, None, None, 7), (1, None, None, 7), (None, "", "x", None), (2, "a b " * 40000, "en", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(docs, budget=3).collect())[:3] == [0, 0, 0]
    assert piece_codec.encode_decode(docs).columns == ["doc_id", "lang", "n_tokens", "ids", "decoded"]
    assert piece_codec.encode_decode(docs).count() == 4
    assert [r.lang_pred for r in language_id.identify(docs, {}).collect()] == ["und"] * 4
    assert language_id.predict_held_out(docs).count() == 4
    empty = docs.limit(0)
    for f in (token_counts.count_tokens, piece_codec.encode_decode, language_id.predict_held_out):
        assert f(empty).count() == 0
    pages = spark.createDataFrame([(1, None, "u"), (1, "<p>a", "u"), (1, "<p>a", "u"), (None, "", None)], "page_id bigint, html string, text string")
    assert sorted(r.text for r in html_text.extract_text(pages).collect()) == ["", "", "a", "a"]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# --- language -------------------------------------------------------------


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            out.update(g for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g != " ")
    # the blank between two words is one blank, but belongs to both
    return out


@pytest.mark.parametrize("block", [1 << 20, 7, 3])
def test_ngrams_equal_plain_version(block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    for t in [*TEXTS, *random_texts(40), "Straße über ÉCOLE, niño"]:
        values, counts = language_id.ngrams(t)
        got = {}
        for v, n in zip(values.tolist(), counts.tolist(), strict=True):
            s, x = "", v
            while x:
                s, x = chr(x & 0x1FFFFF) + s, x >> 21
            got[s] = n
        want = plain_ngrams(t)
        assert got == dict(want)


def test_predictions_equal_out_of_place_distances(spark):
    """Profiles, distances and scores by plain counting and lists."""
    r = random.Random(11)
    letters = {"aa": "abcdefg ", "bb": "defghij  ", "cc": "éñabü "}
    say = lambda lang, n: "".join(r.choice(letters[lang]) for _ in range(n))
    rows = [(i, say(lang, 200), lang) for i in range(30) for lang in (r.choice(sorted(letters)),)]
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    first = lambda counts, n: sorted(counts, key=lambda g: (-counts[g], code(g)))[:n]
    profiles = {lang: first(sum((plain_ngrams(t) for _, t, x in rows if x == lang), Counter()), language_id.PROFILE_SIZE) for lang in letters}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.learn(frame)
    assert learned == {lang: [code(g) for g in p] for lang, p in profiles.items()}
    texts = [*(say(r.choice(sorted(letters)), r.randrange(1, 90)) for _ in range(60)), "", "12 3", None, "zzz"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in language_id.identify(asked, learned).collect():
        own = first(plain_ngrams(row.text or ""), language_id.DOCUMENT_SIZE)
        if not own:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        far = max(language_id.PROFILE_SIZE, *map(len, profiles.values()))
        distance = {lang: sum(abs(p.index(g) - k) if g in p else far for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert row.lang_pred == best and row.score == pytest.approx(max(0.0, 1 - distance[best] / (far * len(own))))


def test_rows_without_key_are_sampled_by_text(spark):
    rows = [(None, f"{'xyz'[i % 3]}ab {i}", "aa") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    few, every = language_id.learn(frame, documents=20), language_id.learn(frame)
    assert few != every and len(few["aa"]) <= len(every["aa"])


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op5_language_id(spark, sf).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(out) > 250
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


# --- chat -----------------------------------------------------------------


def test_template_language():
    out, spans = render("{% for m in messages %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}{# no #}", [{}, {}, {}])
    assert out == "1,2,3" and spans == []
    assert render("{{ 'a' ~ 1 + 1 if 1 == 2 else \"b\" | upper }}", [])[0] == "B"
    assert render("{% set x = messages %}{% if x | length > 1 and true %}{{ x[1].t }}{% elif x %}one{% else %}none{% endif %}", [{"t": 1}, {"t": "z"}])[0] == "z"
    assert render("a{% generation %}b{{ 1 }}{% endgeneration %}c", [])[1] == [(1, 3)]
    assert len(fold_block(parse("a{{ 'b' | upper }}{% if 1 > 2 %}x{% else %}c{% endif %}"))) == 1
    for bad in ["{% for x %}{% endfor %}", "{% if a %}", "{{ a.__class__.b( }}", "{{ f() }}", "{% endfor %}", "{{ 'a' | nothing }}", "{{ }}"]:
        with pytest.raises(TemplateError):
            parse(bad)
    with pytest.raises(TemplateError):
        list(compile_template("{{ x.__class__ }}")(x="s"))


def test_escapes_round_trip():
    for t in [*random_texts(300, 9), "<|im_end|>", "<\\|", "\\", "<", "\\n", "a\nb\\\n"]:
        assert unescape(escape_control(t)) == t and "<|" not in escape_control(t)
        assert unescape(escape_line(t), line=True) == t and "\n" not in escape_line(t)


def test_chat_read_back(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {-1: [("user", queries.CONTROL_SAYING), ("assistant", queries.CONTROL_SAYING)]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op6_chat_formatting(spark, sf).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))


def test_chat_formatted_text_equals_plain_writing(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate([("user", "hi\nthere"), ("assistant", "yes"), ("system", ""), ("assistant", "a b")])]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    plain, spans = "", []
    for _, _, role, text in rows[:4]:
        plain += f"<|im_start|>{role}\n"
        if role == "assistant":
            spans.append((len(plain), len(plain) + len(text)))
        plain += f"{text}<|im_end|>\n"
    assert sorted((x.conv_id, x.part, x.formatted) for x in got) == [(c, 0, plain) for c in range(3)]
    assert all([(s.start, s.end) for s in x.loss] == spans for x in got)
    back = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert all(x.formatted_chars == len(plain) for x in back)


def test_chat_odd_tables(spark):
    rows = [(None, None, None, None), (1, 1, "assistant", "x<|"), (1, 1, "assistant", "x<|"), (1, None, "us\ner", "y\\"), (2, 0, "assistant", "z" * 3000), (2, 1, "assistant", "w")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as formatted", "2 as part")
    for size in (10, 1000000):
        got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns, part_chars=size)).collect()}
        assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {None: (1, 0), 1: (3, 6), 2: (2, 3001)}
        assert got[1].turns_sha256 == sha("us\ner\ny\\\nassistant\nx<|\nassistant\nx<|\n")
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


# --- HTML -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b  c\n d", "a\n\nb c d"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>t", "- a\n- b\n  3. x\n  4. y\n- c\n\nt"),
        ("<table><tr><th>a<th>bbb<tr><td>long one<td>y<tr><td colspan=2>both</table>", "a        | bbb\nlong one | y\nboth"),
        ("<table><td>1<td>2</table>", "1 | 2"),
        ("<div>a<div>b</div>c</div><span>d</span> <b>e</b>", "a\nb\nc\nd e"),
        ("x<div hidden>q</div><p style='display: none'>q</p><i style=\"VISIBILITY:hidden\">q</i>y", "xy"),
        ("<script>if (a</b) '</p>'</script><style>p{}</style><!-- <p>q -->v<title>q</title>", "v"),
        ("a&amp;b &lt;c&gt; 1 < 2 &copy;", "a&b <c> 1 < 2 ©"),
        ("<pre>\n a\n   b</pre>c<br>d", " a\n   b\n\nc\nd"),
        ("<details><summary>s</summary>hid</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
        ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n    b\nc\n    d"),
        ("<a title='>'>k</a></nope><", "k<"),
        ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a          | b\n\nin | ner"),
    ],
)
def test_html_layout(source, text):
    got = html_text.extract(source)
    if "ner" in text:
        assert [x.rstrip() for x in got.split("\n")][0].startswith("a") and "in | ner" in got
    else:
        assert got == text.strip("\n")


OPEN_HEADS = [
    ("<html><head><title>T</title><p>Visible", "Visible"),
    ("<html><head><meta charset=x><link rel=y><style>p{}</style><script>1</script>\n<base href=z>Bare text<p>more", "Bare text\n\nmore"),
    ("<head><title>T</title><noscript><link></noscript><template><p>t</template><table><tr><td>a<td>b</table>", "a | b"),
    ("<head><head></head><div>x</div>", "x"),
    ("<head><title>T</title></head><body><p>x", "x"),
]


@pytest.mark.parametrize(("source", "text"), OPEN_HEADS)
def test_html_open_head_ends_at_content(source, text):
    assert html_text.extract(source) == text


QUOTES = [
    ("<p title=it's>Don't miss this <b>sale</b>", "Don't miss this sale"),
    ("<p title=a\"b>x \"y\" <b>z</b>", "x \"y\" z"),
    ("<p \"odd>x\">y", "x\">y"),
    ("<p title = 'a>b' class=\"c>d\"id=e/f>x", "x"),
    ("<p title=a'hidden'>x<p title=it's hidden>y", "x"),
    ("<p title=\"open>x", "x"),
    ("<p title='open hidden>x", ""),
    ("<p a= >x<p =b>y<p a==>z", "x\n\ny\n\nz"),
]


@pytest.mark.parametrize(("source", "text"), QUOTES)
def test_html_quotes_in_tags(source, text):
    assert html_text.extract(source) == text


FIELDS = [
    ("a <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> b", "a x+1 b"),
    ("<svg><title>t</title><defs><text>no</text></defs>raw<g><text>L<tspan>1</tspan></text><text>L2</text></g></svg> z", "L1 L2 z"),
    ("Say: <textarea>\na  b\n<i>c &amp; d</textarea> e", "Say: a  b\n<i>c & d e"),
    ("Size <select><option disabled>pick<option>S<option selected>M &amp; L<option>XL</select>.", "Size M & L."),
    ("<select><option disabled>pick<optgroup label=g><option>S<option>M</select>", "S"),
    ("<select multiple><option>S<optgroup label=g><option label=N>M</select>", "S\ng\nN"),
    ("<table><tr><td rowspan=2>aa<td>b<td>c<tr><td>d<td>e<tr><td>f</table>", "aa | b | c\n   | d | e\nf"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a | b    | c\nd |   |  | e\nf | g"),
]


@pytest.mark.parametrize(("source", "text"), FIELDS)
def test_html_fields_drawings_and_spans(source, text):
    assert html_text.extract(source) == text


RULES = [
    ("<style>.x, #y{display:none} p.z{visibility:hidden}/* .w{display:none} */@media print{.w{display:none}}</style><p class='a x'>1<p id=y>2<p class=z>3<div class=z>4<div class=w>5", "4\n5"),
    ("<style>b{display:none}</style>a<b>no</b><b style='display:inline'>yes</b>", "ayes"),
    ("<p style='--display:none'>shown<p style='color:red;display:none'>no<p hidden style='display:block'>also", "shown\n\nalso"),
    ("<div style='visibility:hidden'>no <span style='visibility:visible'>yes</span> no</div>", "yes"),
    ("<p>He said <q>go <b>on</b></q>.", "He said \u201cgo on\u201d."),
    ("<div style='white-space:pre'>a   b\n  c</div><pre style='white-space:normal'>d   e</pre>", "a   b\n  c\n\nd e"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<table>loose<tr><td>a</table>then", "loose\na\n\nthen"),
    ("<input value=typed> <input type=submit> <input type=reset value=Clear> <input type=hidden value=no><input placeholder=hint>", "typed Submit Clear hint"),
    ("<table><tr><td>a<td colspan=2>wide<td>b<tr><td>cc<td>d<td>e<td>f</table>", "a  | wide  | b\ncc | d | e | f"),
]


@pytest.mark.parametrize(("source", "text"), RULES)
def test_html_visibility_and_layout_rules(source, text):
    assert html_text.extract(source) == text


def test_html_padding_is_bounded_and_loses_nothing():
    wide = "w" * 3000
    got = html_text.extract("<table><tr><td>" + wide + "<td>x" + "<tr><td>a<td>b" * 50 + "</table>")
    assert got.split("\n")[0] == wide + " | x" and {len(x) for x in got.split("\n")[1:]} == {2 * 3050 // 51 + 4}
    rows = html_text.extract("<table><tr>" + "".join(f"<td>{'y<br>' * 60}c{i}" for i in range(30)) + "</table>")
    assert sorted(rows.split()) == sorted([x for i in range(30) for x in ["y"] * 60 + [f"c{i}"]] + ["|"] * rows.count("|"))
    deep = html_text.extract("<table><tr><td>a<td>" * 30 + "inmost")
    assert deep.count("a") == 30 and deep.endswith("inmost") and len(deep) < 3000
    assert len(html_text.extract("<blockquote>x" * 500).split("\n")[-1]) == html_text.INDENT + 1


#: Markup that makes a careless parser or renderer quadratic.
STRAINS = {
    "open tags": lambda n: "<a " * (n // 3),
    "quoted": lambda n: '<a b=">" ' * (n // 9) + "c='>x",
    "divs": lambda n: "<div>" * (n // 5),
    "lists": lambda n: "<ul><li>" * (n // 8),
    "wide cell": lambda n: "<table><tr><td>" + "w" * (n // 4) + "<td>x" + "<tr><td>a<td>b" * (n * 3 // 56),
    "quotes": lambda n: "<blockquote>x" * (n // 13),
    "nested tables": lambda n: "<table><tr><td>a<td>b<br>c" * (n // 25),
    "spans": lambda n: "<table>" + "<tr><td colspan=1000>a<td>b" * (n // 27),
    "one row": lambda n: "<table><tr>" + "<td colspan=1000>a" * (n // 18),
    "lines": lambda n: "<table><tr><td>" + "a<br>" * (n // 10) + "<td>b" * (n // 10),
    "ends": lambda n: "<div>" * (n // 10) + "</p>" * (n // 8),
    "styles": lambda n: "<style>" + "/*" * (n // 4) + "</style><style>" + "a{" * (n // 4) + "</style>x",
}


@pytest.mark.parametrize("strain", STRAINS)
def test_html_takes_linear_time_and_space(strain):
    import time

    took, size = [], []
    for n in (20_000, 160_000):
        source = STRAINS[strain](n)
        best = []
        for _ in range(2):
            begun = time.perf_counter()
            size.append(len(html_text.extract(source)))
            best.append(time.perf_counter() - begun)
        took.append(min(best))
    assert took[1] < 24 * took[0] + 0.2 and size[-1] <= 9 * size[0] + 500 and size[-1] < 40 * 160_000


class PlainRenderer:
    """Blocks, lists and aligned tables of well-formed markup, by plain recursion over nested lists."""

    def block(self, node):
        """Lines of a node: (tag, children)."""
        tag, children = node
        if tag == "p":
            return [" ".join("".join(children).split())]
        if tag in ("ul", "ol"):
            out = []
            for k, (_, inner) in enumerate(children, 1):
                mark = f"{k}. " if tag == "ol" else "- "
                lines = [x for c in inner for x in ([" ".join(c.split())] if isinstance(c, str) else self.block(c))]
                out += [mark + lines[0], *(" " * len(mark) + x for x in lines[1:])]
            return out
        rows = [[" ".join("".join(cell).split()) for cell in row] for row in children]
        wide = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
        return [" | ".join(c.ljust(wide[k]) for k, c in enumerate(r)).rstrip() for r in rows]

    def source(self, node):
        tag, children = node
        if tag == "p":
            return "<p>" + "".join(children)
        if tag in ("ul", "ol"):
            return f"<{tag}>" + "".join("<li>" + "".join(c if isinstance(c, str) else self.source(c) for c in inner) for _, inner in children) + f"</{tag}>"
        return "<table>" + "".join("<tr>" + "".join("<td>" + "".join(c) for c in row) for row in children) + "</table>"


def test_html_layout_equals_plain_renderer():
    r, plain = random.Random(9), PlainRenderer()
    words = lambda: [r.choice(["ab", "c ", " d", "efg\n", "h"]) + "x" for _ in range(r.randrange(1, 5))]

    def made(depth):
        kind = r.choice(["p", "ul", "ol", "table"]) if depth else r.choice(["ul", "ol"])
        if kind == "p":
            return kind, words()
        if kind == "table":
            return kind, [[words() for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 5))]
        inner = lambda: ["".join(words()), *([made(0)] if depth and r.random() < 0.4 else [])]
        return kind, [("li", inner()) for _ in range(r.randrange(1, 5))]

    for _ in range(300):
        nodes = [made(1) for _ in range(r.randrange(1, 5))]
        assert html_text.extract("".join(map(plain.source, nodes))) == "\n\n".join("\n".join(plain.block(x)) for x in nodes)


def test_html_survives_deep_and_random_markup():
    assert html_text.extract("<div><b><ul><li>" * 3000 + "x").endswith("x")
    r = random.Random(3)
    bits = ["<p>", "</p>", "<td>", "<table>", "</table>", "<li>", "<ul", "a", "\"", "'", ">", "<!--", "-->", "</", "<pre>", "&am", "<tr>", "</div>", "<div hidden>", "=", "<script>"]
    for _ in range(3000):
        html_text.extract("".join(r.choice(bits) for _ in range(r.randrange(30))))


def test_html_loses_no_visible_word(spark, sf):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, sf).collect():
        p = Plain()
        p.feed(sources[r.page_id])
        p.close()
        drop = lambda s: sorted("".join(c if c.isalnum() else " " for c in s).split())
        assert drop(r.text) == drop("".join(p.out))
