"""Every training-data operator on small tables, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from gridloom.llm import bpe, components, html_blocks, html_labeller, near_copies, packing, pii, quality, sharding, simhash, sketch, skew, substring_index, suffix_dedup  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, periodic text, empty and null texts, a repeated row, ties, long text."""
    rng = random.Random(3)
    base, passage = words(rng, 300), words(rng, 120)
    texts = [words(rng, rng.randint(1, 200)) for _ in range(20)]
    texts += [base] * 6 + [base[:500] + " changed " + base[500:], base[:-9], "x " + base]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(5)]
    texts += ["ab " * 400, "ab " * 300 + "z", "", None, " \n\t ", "one", "A b\nA b\nC", "ünï " * 150, words(rng, 8000)]
    out = [(i * 3, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[4], (0, "other text of the same id", "en", "s", 3), (None, base + " null id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id bigint, quality int, toxic int")


def collected(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# 1


def test_pseudonyms_keep_format_and_link(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111-1111-1111-1111 and 4111111111111112", "mail ann.b@x.example.org", "call +1 (171) 555-2028", "from 10.2.3.255 not 10.2.3.256", "born 2000-02-29, 31.12.1999, 31/02/2000",
        "ssn 123-45-6789 or 000-12-3456", "DE89370400440532013000 and DE89370400440532013001", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "version 3.0, CC BY-NC 4.0", "", None,
    ]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, __x string")
    got = [r.text for r in pii.pseudonymize(df).orderBy("doc_id").collect()]
    cards = [c for c in __import__("re").findall(r"\d[\d -]{14,18}\d", got[0])]
    digits = ["".join(x for x in c if x.isdigit()) for c in cards]

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    assert digits[0] == digits[1] != "4111111111111111" and luhn(digits[0]) and not luhn(digits[2]) and cards[1].count("-") == 3
    assert got[1].endswith("@x.example.org") and "ann.b" not in got[1] and len(got[1]) == len(texts[1])
    assert got[2].startswith("call +1 (") and "555" not in got[2]
    assert got[3].endswith("not 10.2.3.256") and "10.2.3.255" not in got[3]
    assert got[4].endswith("31/02/2000") and "2000-02-29" not in got[4]
    assert got[5].endswith("000-12-3456") and "123-45-6789" not in got[5]
    iban = got[6].split()[0]
    moved = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(moved) % 97 == 1 and iban != "DE89370400440532013000" and got[6].endswith("DE89370400440532013001")
    assert "b44e15" not in got[7] and len(got[7]) == len(texts[7])
    assert got[8:] == texts[8:]
    other = [r.text for r in pii.pseudonymize(df, key="k2").orderBy("doc_id").collect()]
    assert other[0] != got[0]


def test_permutations_are_one_to_one(spark):
    n = spark.range(146097).select(pii.permute_pair(F.floor(F.col("id") / 773), 189, F.col("id") % 773, 773, "k", "date").alias("p"))
    assert n.distinct().count() == 146097 and n.where("p.x between 0 and 188 and p.y between 0 and 772").count() == 146097
    t = spark.range(10000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "n").alias("t"))
    assert t.distinct().count() == 10000 and t.where("t rlike '^[0-9]{4}$'").count() == 10000


def test_what_follows_a_phone_is_not_eaten(spark):
    phones = ["+1 (555) 123-4567", "+1 555 123 4567", "+49 30 1234567", "+44 20 7946 0958", "+44 (555) 123-4567"]
    after = ["192.168.10.20", "2020 units", "2020-02-29", "31/12/1999", "123-45-6789", "4111 1111 1111 1111", "555-123-4567"]
    texts = [*phones, *after, *[f"{p} {a}" for p in phones for a in after], "+62 812 3456 7890", "+49.30.12.34.56", "+49 170 1234 2020"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = dict(zip(texts, [r.text for r in pii.pseudonymize(df).orderBy("doc_id").collect()], strict=True))
    assert got["2020 units"] == "2020 units" and all(got[x] != x for x in texts if x != "2020 units")
    assert all(got[f"{p} {a}"] == f"{got[p]} {got[a]}" for p in phones for a in after)
    assert got["+49 170 1234 2020"][-4:] != "2020" and got["+62 812 3456 7890"][-4:] != "7890" and got["+49.30.12.34.56"][-2:] != "56"


def test_month_first_dates(spark):
    days = [(i, f"{m:02}/{d:02}/20{y:02}") for i, (m, d, y) in enumerate((m, d, y) for m in range(1, 13) for d in range(13, 29) for y in range(10))]
    df = spark.createDataFrame([*days, (9999, "13/13/2020")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(df).collect()}
    assert got.pop(9999) == "13/13/2020" and len(set(got.values())) == len(days)
    assert all(int(x[:2]) <= 12 < int(x[3:5]) for x in got.values()) and sum(got[i] != x for i, x in days) > 0.99 * len(days)


# 2


def test_blocks_of_html():
    page = "<title>no</title><p><b>a &amp; b<br>c<p>d<!-- x --></p><script>var t='</p>'</script><ul><li><a href=#>e</a><li>f</ul>g<br><div hidden>h \n i"
    assert [b.text for b in html_blocks.blocks(page)] == ["a & b c", "d", "e", "f", "g", "h i"]
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("plain &lt;text&gt;")] == ["plain <text>"]


def test_a_tag_ends_where_html_ends_it():
    page = "<article><p class=it's>one</p><p>two</p><p title='a > b'>don't stop</p><p data-x=\"it's > that\">x</p></article>"
    assert [b.text for b in html_blocks.blocks(page)] == ["one", "two", "don't stop", "x"]
    assert [b.text for b in html_blocks.blocks("<p>a</p><p class='open>b</p><p>c</p>")][0] == "a"
    assert html_blocks.blocks("<p " + "a='b' c=\"d\" " * 5000) is not None  # no end: in time that grows with the page


def test_articles_of_div_paragraphs(spark):
    rng = random.Random(12)
    texts = [words(rng, 60).replace("\n", " ") for _ in range(5)]
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    page = f"<html><body>{menu}<div id=main><h1>Ein Titel hier</h1>" + "".join(f"<div>{t}</div>" for t in texts) + "</div><footer><p>copyright terms</p></footer></body></html>"
    row = html_labeller.page_digest(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")).first()
    assert row.text.split("\n")[-5:] == texts and "Home" not in row.text and "copyright" not in row.text


def test_labeller_on_held_out_pages(spark, data):
    model = html_labeller.Labeller.load(html_labeller.trained(spark))
    xs, ys = html_labeller.practice(50_000, 200)
    right = np.concatenate([(s >= 0.5) == (y > 0) for s, y in zip(model.scores(xs), ys, strict=True)])
    assert right.mean() > 0.985
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in html_labeller.page_digest(pages).join(pages.select("page_id", "html"), "page_id").collect():
        found = html_blocks.blocks(r.html)
        assert r.text == "\n".join(b.text for b in found if "article" in b.path) and r.n_chars == len(r.text)


def test_pages_null_and_empty(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<nav>x</nav>"), (4, "u", "<article><p>one</p></article>")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_labeller.page_digest(df).collect()}
    assert got[1] == got[2] == got[3] == ("", 0) and got[4] == ("one", 3)
    assert html_labeller.page_digest(df.where("false")).count() == 0


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(1)
    model = html_labeller.Labeller.fresh()
    x = [rng.normal(size=(n, html_labeller.PATH + html_labeller.WORDS + html_labeller.MEASURES)).astype(np.float32) for n in (1, 3, 7)]
    y = [np.ones(n, np.float32) for n in (1, 3, 7)]
    before = np.concatenate(model.scores(x)).mean()
    model.train(x, y, epochs=20)
    assert np.concatenate(model.scores(x)).mean() > max(before, 0.9)


# 3


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize(("limit", "radius"), [(2, 2), (2000, 2), (2000, 4), (150, 4)])
def test_near_links_lose_none(spark, limit, radius):
    rng = random.Random(limit)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for s in seeds for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    roots = {r.node & (2**64 - 1): r.root for r in components.components(simhash.near_links(df, limit, radius)).collect()}
    expected = brute_components(prints, radius)
    groups = {}
    for p, e in zip(prints, expected, strict=True):
        groups.setdefault(e, set()).add(roots.get(p, p if p < 1 << 63 else p - (1 << 64)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_digest(docs, rows, empty):
    got = collected(simhash.near_digest(docs), "doc_id", "fingerprint", "component_id")
    prints = [brute_print(r[1]) for r in rows]
    root = brute_components(prints)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert got == Counter((r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, root, strict=True))
    assert simhash.near_digest(empty).count() == 0


def test_one_of_each_group_stays(docs):
    odd = docs.withColumns({"fp": F.lit("mine"), "component_id": F.lit(1), "root": F.lit(2)})
    out = near_copies.keep_one(odd)
    assert out.columns == odd.columns and out.where("fp <> 'mine'").count() == 0
    groups = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect() if r.doc_id is not None}
    assert {r.doc_id for r in out.where("doc_id is not null").collect()} == set(groups.values())


def test_a_document_without_an_id_stays_if_it_is_alone(spark):
    df = spark.createDataFrame([(None, "alone here in the world", "", "", 0), (1, "two of a kind go together", "", "", 0), (None, "two of a kind go together", "", "", 0)], DOCS)
    kept = [(r.doc_id, r.text[:5]) for r in near_copies.keep_one(df).collect()]
    assert (None, "alone") in kept and (1, "two o") in kept


def test_kept_documents_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [words(rng, 1) + str(i) for i in range(300)]
    texts = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.03, 0.06):  # words changed: likeness from 0.95 to 0.55
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    expected = {find(i) for i in range(len(texts))}
    kept = near_copies.keep_one(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS).repartition(3))
    assert {r.doc_id for r in kept.collect()} == expected and 60 < len(expected) < 250


def test_large_buckets_and_hot_keys_lose_no_link(spark, monkeypatch):
    """Every join is split, and buckets of many texts, linked in chains or not at all, take several rounds."""
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    monkeypatch.setattr(skew, "HOT_KEYS", 2000)
    monkeypatch.setattr(near_copies, "PART_ROWS", 7)
    monkeypatch.setattr(near_copies, "HUBS", 60)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(300)]
    texts = []
    for i in range(90):  # all share 300 words; every tenth starts a chain of texts that are alike in turn
        step = i % 10
        own = [f"t{i // 10}w{j}" for j in range(step * 20, step * 20 + 150)]
        texts.append(" ".join(common + own))
    texts += [" ".join(common + [f"x{i}y{j}" for j in range(150)]) for i in range(40)] + [texts[3]] * 5
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in range(12):
        for i in range(len(texts)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_joins_with_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(500)] + [(None, 1)], "k int, v int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3")
    plain = Counter(map(tuple, rows.join(keyed, ["k"]).collect()))
    for hot in (1, 75, 10_000):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        assert Counter(map(tuple, skew.join_hot(rows, keyed, ["k"]).collect())) == plain
        assert skew.join_hot(rows, keyed, ["k"], "left_semi").count() == sum(plain.values())


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50))


# 4


def test_suffix_dedup(docs, rows, empty):
    length = suffix_dedup.LENGTH
    data = [(r[1] or "").encode() for r in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    expected = Counter()
    for r, d in zip(rows, data, strict=True):
        spans = suffix_dedup.merge_windows(*[[i for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1]] * 2)
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + d[at:a], z
        expected[(r[0], len(d), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept + d[at:]).hexdigest())] += 1
    assert collected(suffix_dedup.dedup_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert suffix_dedup.dedup_digest(empty).count() == 0


@pytest.mark.parametrize("n_bytes", [350, 399, 400, 401])
def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark, n_bytes):
    rng = random.Random(n_bytes)
    passage = "".join(rng.choice("abcde") + "fghi " for _ in range(90))[: n_bytes - 1] + "."
    assert len(passage.split()) > 50 and len(passage.encode()) == n_bytes
    texts = [f"{words(rng, 40)}<{passage}>{words(rng, 40)}", f"{words(rng, 40)}[{passage}]{words(rng, 40)}", words(rng, 150)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    kept = [t.replace(passage, "") if n_bytes >= 400 else t for t in texts]
    expected = Counter((i, len(t.encode()), len(t.encode()) - len(k.encode()), int(k != t), hashlib.sha256(k.encode()).hexdigest()) for i, (t, k) in enumerate(zip(texts, kept, strict=True)))
    assert collected(suffix_dedup.dedup_digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_long_texts_are_cut_into_overlapping_parts(spark, monkeypatch):
    rng = random.Random(9)
    a, b = words(rng, 900), words(rng, 900)
    df = spark.createDataFrame([(1, a + b, "", "", 0), (2, b + a, "", "", 0), (3, words(rng, 500), "", "", 0)], DOCS)
    whole = collected(suffix_dedup.dedup_digest(df), "doc_id", "n_removed", "kept_sha256")
    texts = [(a + b).encode(), (b + a).encode()]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = list(suffix_dedup._pieces(texts, suffix_dedup.LENGTH))
    starts = {(int(r), int(s)) for rows, ss, _, _ in parts for r, s in zip(rows, ss, strict=True)}
    assert {(0, 0), (0, 700), (1, 0), (1, 700)} <= starts
    assert sum(n for (d, n, _), _ in whole.items() if d < 3) == len(a.encode()) * 2 + len(b.encode()) * 2


# 5


def test_sketch_digest(docs, rows, empty):
    got = sketch.sketch_digest(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    unique = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None]
    order = sorted({r[0] for r in rows if r[0] is not None})
    text = {r[0]: r[1] or "" for r in rows}
    by = {r.doc_id: r for r in got}
    for r in unique:
        following = order[(order.index(r[0]) + 1) % len(order)]
        if order.index(r[0]) + 1 == len(order) or following in (0, rows[4][0]):
            continue
        t, m = text[r[0]], len(text[r[0]]) // 4
        edited = t[: len(t) - m] + text[following][:m]
        assert (by[r[0]].n_chars, by[r[0]].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    same = {}
    for r in unique:
        same.setdefault(r[1] or "", set()).add(by[r[0]].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert sketch.sketch_digest(empty).count() == 0


def test_sketches_merge_and_contain(spark):
    rng = random.Random(8)
    a, b = words(rng, 3000), words(rng, 3000)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    for c in df.columns:
        df = sketch.with_sketch(df, F.col(c), f"s_{c}")
    row = df.select(sketch.likeness(F.col("s_a"), F.col("s_ab")).alias("inside"), sketch.likeness(F.col("s_a"), F.col("s_b")).alias("apart"), sketch.likeness(sketch.merge(F.col("s_a"), F.col("s_b")), F.col("s_ab")).alias("merged"), F.size("s_a").alias("n")).first()
    assert row.inside > 0.98 and row.apart < 0.05 and row.merged > 0.98 and 0.67 < row.n * sketch.SCALE / 2996 < 1.34


def test_merged_sketches_are_those_of_both_shingle_sets(spark):
    rng = random.Random(9)
    texts = [words(rng, n) for n in (5, 5, 6, 7, 9, 12, 30, 500)] + ["", "one two"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    hashes = lambda c: sketch.shingle_hashes(sketch.words(F.col(c)))
    both = sketch.threshold(F.concat(hashes("a"), hashes("b")))
    merged = sketch.merge(sketch.threshold(hashes("a")), sketch.threshold(hashes("b")))
    assert df.select(both.alias("x"), merged.alias("y")).where("not x <=> y").count() == 0


def test_sketches_against_python(spark):
    """The likeness of sketches is that of the hashes below the threshold, found in plain Python."""
    rng = random.Random(10)
    texts = [words(rng, n) for n in (40, 400, 1500, 3000)]
    df = spark.createDataFrame([(i, t, h) for i, t in enumerate(texts) for h in [None]], "doc_id bigint, text string, h string")
    out = {r.doc_id: r for r in sketch.sketch_digest(df.withColumns({"tie": F.lit(1), "own": F.lit(1), "next": F.lit(1), "__words": F.lit(1)})).collect()}
    hashed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", sketch.shingle_hashes(sketch.words(F.col("text"))).alias("h")).collect()
    low = {r.i: sorted({h for h in r.h if 0 <= h < 2**64 // sketch.SCALE}) or [min(r.h, key=lambda h: h % 2**64)] for r in hashed}
    for i in range(4):
        a, b = set(low[i]), set(low[(i + 1) % 4])
        assert out[i].near_next == pytest.approx(len(a & b) / min(len(a), len(b)))
        assert out[i].fingerprint == "".join(f"{(h % 2**64) >> 16:012x}" for h in low[i])


# 6


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, RANKS, PATTERN).collect()
    enc = packing.encoding(RANKS, PATTERN)
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.append(np.array(enc.encode_ordinary(r[1] or ""), dtype="<u4"), np.uint32(0)).astype("<u4"))
    pieces = Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got)
    expected = Counter((d, s, len(x[s : s + 1024]), zlib.crc32(x[s : s + 1024].tobytes()), len(x)) for d, xs in ids.items() for x in xs for s in range(0, len(x), 1024))
    assert pieces == expected
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty, RANKS, PATTERN).count() == 0


def test_ids_are_those_of_the_tokenizer_file(rows):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    enc = packing.encoding(RANKS, PATTERN)
    for text in [r[1] for r in rows if r[1]] + ["<|endoftext|> 12'll  \n\n x", "日本 ﬁ\u00a0\u2003é"]:
        assert enc.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_found_as_by_the_library(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["ab <|endoftext|> c", "<|endoftext|>", "x<|endoftext|><|endoftext|>y ", "<|endoftext| >", "plain 12'll"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    assert 50256 in ids[0]
    got = {(r.doc_id, r.ids_crc32, r.doc_tokens) for r in packing.cut_pieces(df, RANKS, PATTERN).collect()}
    assert got == {(i, zlib.crc32(x.tobytes()), len(x)) for i, x in enumerate(ids)}


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_every_piece_with_little_waste(seed):
    rng = np.random.default_rng(seed)
    n = [30, 500, 20_000, 300_000][seed]
    lengths = np.clip(rng.lognormal(3.6, 1.0, n).astype(int), 1, 256)
    histogram = {int(s): int(c) for s, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    packed = packing.pack_histogram(histogram, 256)
    used = Counter()
    for pattern, copies in packed:
        assert sum(s * a for s, a in pattern.items()) <= 256
        for s, a in pattern.items():
            used[s] += a * copies
    assert used == histogram
    assert sum(c for _, c in packed) <= 1.02 * lengths.sum() / 256 + 2
    assert packing.pack_histogram({}, 256) == [] and sum(c for _, c in packing.pack_histogram({200: 7}, 256)) == 7


# 7


def test_features(docs, rows, empty, labels):
    def brute(t):
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    out = quality.quality_digest(docs, labels)
    got = collected(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((r[0], *(f := brute(r[1])), f[0] < 10 or 100 * f[4] > 20 * f[0]) for r in rows)
    assert out.where("kept and base_failed").count() == 0 and quality.quality_digest(empty, labels).count() == 0
    assert quality.quality_digest(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_cutoffs_keep_their_promise(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(3000):
        junk = i % 4 == 0
        text = " ".join(words(rng, 1) + ("***" if junk or rng.random() < 0.02 else "") for _ in range(40))
        rows.append((i, text, ("a", "b", "few")[2 if i < 20 else i % 2], "s", 0))
        marks.append((i, int(not junk), 0))
    out = quality.quality_digest(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()
    good, bad = [r for r in out if r.doc_id % 4 and r.doc_id >= 20], [r for r in out if r.doc_id % 4 == 0 and r.doc_id >= 20]
    assert sum(not r.kept for r in good) <= 0.05 * len(good) and all(not r.kept for r in bad)
    assert all(r.kept for r in out if r.doc_id < 20 and not r.base_failed)  # too few labels to certify anything


def test_a_document_counts_once_however_often_it_is_labelled(docs, labels, empty):
    features = quality.with_base(quality.with_features(docs, ["doc_id", "lang"]))
    once = Counter(map(tuple, quality.cutoffs(features, labels, "lang").collect()))
    assert Counter(map(tuple, quality.cutoffs(features, labels.union(labels), "lang").collect())) == once


def test_exact_binomial():
    assert abs(quality.binomial_at_most(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert quality.certified_step(1000, [0] * len(quality.PATH), [5] * len(quality.PATH), 0.05, 0.01) == 0
    assert quality.certified_step(50, [0] * len(quality.PATH), [5] * len(quality.PATH), 0.05, 0.01) is None


def test_kept_documents_carry_their_columns(docs, labels):
    odd = docs.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1))
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns and out.where("n_words <> 'mine'").count() == 0 and 0 < out.count() < odd.count()


# 8


def brute_windows(rows):
    first = {}
    data = [(r[0] if r[0] is not None else 2**63 - 1, (r[1] or "").encode().split()) for r in rows]
    for d, w in data:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = Counter()
    for (d, w), r in zip(data, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out[(r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, rows, empty, batches):
    got = collected(substring_index.dedup_digest(docs, batches), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_windows(rows)
    assert substring_index.dedup_digest(empty, batches).count() == 0


def test_index_compacts_and_stays_right(spark, docs, rows):
    texts = substring_index._texts(docs, "doc_id", "text")
    index = substring_index.FingerprintIndex(spark, buckets=3, max_runs=1)
    seen = None
    for low, high in ((-1, 30), (30, 70), (70, 2**63 - 1)):
        found = index.add(texts.where((F.col("d") > low) & (F.col("d") <= high)))
        seen = found if seen is None else seen.unionByName(found)
    assert index.live == 1
    index.drop()
    flagged = {r.d for r in substring_index.verified(seen, texts).collect()}
    assert flagged == {(d if d is not None else 2**63 - 1) for d, _, n, _ in brute_windows(rows) if n}


@pytest.mark.parametrize("contents", [2, 500_000])
def test_hot_grams_and_contents_lose_no_window(spark, docs, rows, monkeypatch, contents):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(substring_index, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(substring_index, "CONTENTS", contents)
    rng = random.Random(8)
    line = words(rng, 14)
    many = rows + [(1000 + i, f"{words(rng, 15)} {line} {words(rng, 15)} {line if i % 2 else ''}", "en", "s", 1) for i in range(60)]
    table = spark.createDataFrame(many, DOCS).repartition(3)
    assert substring_index.hot_grams(substring_index._texts(table, "doc_id", "text"))
    for batches in (1, 3):
        assert collected(substring_index.dedup_digest(table, batches), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(many)


def test_contents_seen_before():
    firsts, gram, name = {}, np.array([5, 5, 5, 6], dtype=np.uint64), np.array([1, 1, 2, 1], dtype=np.uint64)
    assert substring_index._seen_before(gram, name, np.array([4, 3, 1, 9]), firsts).tolist() == [True, False, False, False]
    assert substring_index._seen_before(gram, name, np.array([2, 3, 9, 9]), firsts).tolist() == [False, True, False, False]
    assert substring_index._seen_before(gram[:1], name[:1], np.array([2]), firsts).tolist() == [False]


def test_removed_passages_follow_in_the_text(docs):
    odd = docs.withColumn("cuts", F.lit(1))
    out = substring_index.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is not null and n_chars <> char_length(text)").count() == 0


# 9


def test_shards(docs, rows, empty):
    out = sharding.shard_documents(docs).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sharding.shard_documents(empty).count() == 0
    kept = sharding.uniform_shards(docs.withColumn("shard", F.lit("mine")).withColumn("rank", F.lit(1)), "doc_id", 3, seed=1)
    assert kept.count() == len(rows) and set(kept.columns) == {*docs.columns, "rank", "shard", "slot"}


def test_communication_matrix():
    counts, cells = [0, 5, 100, 17], [40, 41, 41]
    m = sharding.communication_matrix(counts, cells, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == cells
    rng = np.random.Generator(np.random.PCG64(1))
    draws = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 400) for _ in range(300)]
    assert 297 < np.mean(draws) < 303 and all(0 <= d <= 400 for d in draws)


def test_a_large_matrix_is_drawn_in_bounded_time():
    import time

    start = time.time()
    m = sharding.communication_matrix([10**10 // 4096] * 4096, sharding._even(10**10 // 4096 * 4096, 16), 3)
    assert time.time() - start < 30 and m.shape == (4096, 16) and len(set(m.sum(axis=0).tolist())) <= 2 and m.min() > 0


def test_shards_are_uniform(spark):
    ids = sharding.uniform_shards(spark.range(20_000), "id", 4, seed=2, n_blocks=64)
    for shard, low in ids.groupBy("shard").agg(F.avg((F.col("id") < 10_000).cast("double"))).collect():
        assert abs(low - 0.5) < 0.03
    r = ids.where("shard = 0").agg(F.corr("id", "slot")).first()[0]
    assert abs(r) < 0.06


# 10


def test_bpe_like_the_library(docs, rows, empty):
    enc = packing.encoding(RANKS, PATTERN)
    expected = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        expected[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert collected(bpe.encode_digest(docs, RANKS, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe.encode_digest(empty, RANKS, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs.where("doc_id is not null"), RANKS, PATTERN), RANKS, PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows if r[0] is not None)


def test_bpe_on_odd_pieces():
    enc, own = packing.encoding(RANKS, PATTERN), bpe.Codec(RANKS, PATTERN)
    rng = random.Random(2)
    texts = ["a" * 1000, "ab" * 700, "日本語" * 200, " " * 300 + "x", "\n\n \t", "'s't're", "<|endoftext|>", "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(2000)), "".join(rng.choice("etaoinshr") for _ in range(3000))]
    texts += ["a" * 7001, "x" * 40_000, "".join(rng.choice("abc") for _ in range(20_000)), "".join(rng.choice("日本語のテキスト") for _ in range(900)), "th" * 300 + "e" * 301, "=" * 999, "aaab" * 333]
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids == enc.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_bucket_joins_keep_one_plan(spark, tmp_path):
    """With or without a hot bucket the rows are split the same way, and none is lost."""
    rows = spark.createDataFrame([(i % 7, i) for i in range(70)] + [(None, 70)], "k int, i int")
    path = str(tmp_path / "keyed")
    rows.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n").write.parquet(path)
    found = skew.join_hot(rows, spark.read.parquet(path), ["k"], always=True)
    assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.i, r.n) for r in found.collect()) == sorted((i % 7, i, 10) for i in range(70))


def test_rows_go_through_one_join_with_hot_keys_or_without(spark, tmp_path, monkeypatch):
    """An anti-join ran only where some key was hot, and then had all rows: counts of one table and another did not compare."""
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i % 2, i) for i in range(300)] + [(None, 0, 300), (1, None, 301)], "k bigint, m int, i int")
    path = str(tmp_path / "keyed")
    rows.groupBy("k", "m").agg(F.count("*").alias("n")).where("coalesce(k, 0) <> 3").write.parquet(path)
    keyed = spark.read.parquet(path)
    plain = Counter(map(tuple, rows.join(keyed, ["k", "m"]).collect()))
    for least in (0, 30, 10_000):
        monkeypatch.setattr(skew, "HOT_ROWS", least)
        found = skew.join_hot(rows, keyed, ["k", "m"])
        assert Counter(map(tuple, found.collect())) == plain
        assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()
        assert skew.join_hot(rows, keyed, ["k", "m"], "left_semi").count() == sum(plain.values())
