"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqpart.llm import bpe, chat_format, line_rules, queries, simhash, spaced_seeds, splitters, suffix_index, token_counts, toxicity, url_filter

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents, with columns named like the operators' own."""
    base = [(1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, "  \n\t "), (6, prose(2, 4000)), (6, prose(2, 4000)),
            (7, prose(1, 79) + " other"), (8, "é漢😀 <|endoftext|> x"), (None, prose(3, 30)), (9, "one"), (10, prose(4, 200) + "\n" + prose(1, 60))]
    rows = [(i, t, "en", "s" if i != 9 else None, len(t or ""), 1, 2, "k") for i, t in base]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, spans string").repartition(3)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    assert oracle.differences(oracle.connect(sf), queries.QUERIES[name](spark, sf), queries.SQL[name]) == []


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_encoding_is_the_librarys(spark, docs):
    t = Tokenizer.from_file(VOCAB)
    t.no_truncation()
    t.no_padding()
    got = sorted(map(tuple, bpe.digests(docs, VOCAB).collect()), key=repr)
    want = []
    for i, text in texts(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    again = bpe.decoded(bpe.with_ids(docs, VOCAB), VOCAB)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(((i, x or "") for i, x in texts(docs)), key=repr)
    assert bpe.digests(docs.limit(0), VOCAB).count() == 0


def test_token_sums(spark, docs):
    lengths = [r.n_tokens for r in bpe.counted(docs, VOCAB).collect()]
    for r in token_counts.suffix_sums(token_counts.histogram(docs, VOCAB)).collect():
        at = r.context_limit
        assert r.truncated_total == sum(min(x, at) for x in lengths) and r.docs_over == sum(x > at for x in lengths)
        assert r.tokens_over == sum(x for x in lengths if x > at) and r.tokens_total == sum(lengths)
    quantiles = token_counts.quantile_lengths(token_counts.suffix_sums(token_counts.histogram(docs, VOCAB)), [0.5, 1.0])
    assert dict(map(tuple, quantiles.collect()))[1.0] == max(lengths)
    assert token_counts.suffix_sums(token_counts.histogram(docs.limit(0), VOCAB)).count() == 0


def brute_fingerprint(text, shingle):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, radius):
    ids = {}
    for i, fp in rows:
        ids.setdefault(fp, []).append(i)
    root = {f: f for f in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(a ^ b).count("1") <= radius:
            root[find(a)] = find(b)
    least = {}
    for f, own in ids.items():
        for i in own:
            if i is not None:
                least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in ids}


def test_simhash(spark, docs):
    rows = [(i, brute_fingerprint(t, 4)) for i, t in texts(docs)]
    least = brute_components(rows, 4)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.grouped(docs).collect()), key=repr)
    assert got == sorted(((i, fp, least[fp]) for i, fp in rows), key=repr)
    assert simhash.grouped(docs.limit(0)).count() == 0


def brute_first(rows, shingle):
    """Smallest ids of groups of texts whose shingle sets are at least 0.8 alike."""
    sets, group = {}, {}
    for i, text in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        sets.setdefault(i, []).append({" ".join(w[j:j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set())
    flat = [(i, s) for i, own in sets.items() for s in own]
    group = list(range(len(flat)))
    for a, b in itertools.combinations(range(len(flat)), 2):
        x, y = flat[a][1], flat[b][1]
        if x == y or (x | y and 5 * len(x & y) >= 4 * len(x | y)):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return sorted({min(flat[k][0] for k in range(len(flat)) if group[k] == g) for g in group})


@pytest.mark.parametrize("size", [3, 512])
def test_near_copies(spark, docs, size):
    def changed(seed, n, at):
        w = prose(seed, n).split()
        for k in at:
            w[k] = f"changed{seed}x{k}"
        return " ".join(w)

    more = [(100 + k, changed(40, 200, range(0, 20 * (k % 4), 50 - k))) for k in range(12)] + [(200 + k, changed(41 + k, 60, [])) for k in range(8)]
    more += [(300 + k, changed(60, 150, [10 * k])) for k in range(10)] + [(400, changed(70, 100, [])), (401, changed(70, 100, range(3, 60, 6)))]
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, "k") for i, t in more], docs.schema))
    kept = simhash.first_of_each(df, slice_size=size)
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and got.count(None) == 1
    assert sorted(i for i in got if i is not None) == brute_first([(i, t) for i, t in texts(df) if i is not None], 5)
    assert simhash.first_of_each(docs.limit(0)).count() == 0


def test_near_copies_that_repeat_a_phrase(spark):
    """Repeats don't count: neither in the similarity nor in the fingerprint that the trees follow."""
    whole = prose(80, 162)
    rows = [(1, whole), (2, whole + " again and again and again" * 30), (3, prose(81, 162))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = {r.doc_id: r for r in simhash.sketches(df, simhash.TEXT_SHINGLE).collect()}
    assert simhash.alike(*(np.frombuffer(own[i].shingles, np.uint32) for i in (1, 2)))
    counted = [simhash.fingerprint(t.encode(), simhash.TEXT_SHINGLE) for _, t in rows[:2]]
    assert (counted[0] ^ counted[1]).bit_count() > simhash.TEXT_RADIUS >= (own[1].fp ^ own[2].fp).bit_count()
    assert sorted(r.doc_id for r in simhash.first_of_each(df).collect()) == [1, 3]


@pytest.mark.parametrize("size", [5, 4096])
def test_simhash_links_of_a_crowd(spark, size):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for s in seeds for _ in range(60)}
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, slice_size=size)).collect()}
    want = brute_components([(f, f) for f in fps], 4)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(got.get(f, f - 2**64 if f >> 63 else f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        new = []
        for at in range(len(data) - length + 1):
            w = data[at:at + length]
            if w in seen or w in new[-1:]:
                gone[at:at + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for at in range(len(data)) if gone[at] and not (at and gone[at - 1]))
        out[i] = (i, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"batches": 7, "hot": 2, "chunk": 900}, {"batches": 3, "length": 40, "k": 12, "hot": 1, "chunk": 700}])
def test_repeated_bytes(spark, docs, options):
    shared = prose(9, 60)
    rows = [(i, t) for i, t in dict(texts(docs)).items()] + [(20 + i, prose(30 + i, 20) + shared[:150 + 20 * i] + prose(50 + i, 9)) for i in range(12)]
    rows += [(50, "ab" * 400), (51, "x" + "ab" * 300), (52, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r) for r in suffix_index.digests(df, **options).collect()}
    assert got == brute_repeats(rows, options.get("length", 100))
    assert suffix_index.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"batches": 3, "hot": 2, "chunk": 900}, {"batches": 2, "hot": 1, "chunk": 4000, "length": 40, "k": 12}])
def test_repeated_rows_are_one_document(spark, docs, options):
    """Each of the rows has what the document has, whether they meet in one task or in the scan."""
    rows = texts(docs) + [(i, prose(200 + i, 50) + prose(300, 30) * (i % 2)) for i in (60, 60, 61, 61, 61)] + [(63, "ab" * 300)] * 2
    want = brute_repeats(list(dict(rows).items()), options.get("length", 100))
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [tuple(r) for r in suffix_index.digests(df, **options).collect()]
        assert sorted(got, key=repr) == sorted((want[i] for i, _ in rows), key=repr)
    left = suffix_index.without_repeats(docs)
    assert [r.text for r in left.filter("doc_id = 6").collect()] == [prose(2, 4000)] * 2


def test_repeats_leave_the_other_columns(spark, docs):
    left = suffix_index.without_repeats(docs)
    assert left.columns == docs.columns
    by = {r.doc_id: r for r in left.collect()}
    assert by[1].text == prose(1, 80) and 2 not in by and by[3].text is None and by[4].text == ""
    assert by[10].n_chars == len(by[10].text) and by[1].spans == "k"


def test_levels_merge_geometrically(spark):
    index = suffix_index.SuffixIndex(spark)
    for i in range(5):
        index.add(spark.createDataFrame([(i, prose(i, 100))], "doc_id long, text string"))
    assert [n for n, *_ in index.levels] == [4, 1]
    # A merged level still knows what its first and its last batch brought; what only repeats earlier text brings it nothing.
    for level in index.levels:
        assert level[1].filter(F.col("kind") != suffix_index.ENTRIES).count() == 0
    index.add(spark.createDataFrame([(9, prose(0, 100)), (10, prose(3, 100)), (11, prose(4, 100)), (12, prose(77, 100))], "doc_id long, text string"))
    assert [n for n, *_ in index.levels] == [4, 2]
    said = index.rows().filter(F.col("kind") == suffix_index.REPEATED).select("doc").distinct().collect()
    assert {r.doc for r in said} == {9, 10, 11}
    index.close()
    assert index.levels == [] and index.rows().count() > 0


def test_registered_batches_merge(spark, docs):
    """With the batches of the query, levels merge before the last batch is scanned."""
    sizes, add = [], suffix_index.SuffixIndex._add

    def watched(self, part, last):
        add(self, part, last)
        sizes.append([n for n, *_ in self.levels])

    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_index.SuffixIndex, "_add", watched)
        assert suffix_index.digests(docs.filter("doc_id is not null")).count() > 0
    assert sizes[:3] == [[1], [2], [2, 1]]


def test_masks_miss_nothing():
    for size, missing, masks in [(13, 2, spaced_seeds.MASKS), *((n, int(0.2 * n), spaced_seeds.SHORT_MASKS) for n in range(8, 13))]:
        for gone in itertools.combinations(range(size), missing):
            assert any(not any(o + p in gone for p in m) for m in masks for o in range(size - m[-1])), (size, gone)


def test_decontamination(spark, docs):
    items = [(1, prose(100, 30)), (2, prose(101, 9)), (3, None), (4, "too short"), (5, prose(102, 13)), (5, prose(103, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a, b, c = (prose(s, n).split() for s, n in ((100, 30), (101, 9), (102, 13)))
    a[3] = a[11] = a[20] = "zzz"
    b[4] = "zzz"
    c[1] = c[6] = c[9] = "zzz"  # three of thirteen: too many
    more = [(101, prose(5, 50) + " " + " ".join(a).upper() + " " + prose(6, 50)), (102, prose(7, 300) + " " + " ".join(b)), (103, " ".join(c)), (104, prose(103, 40)[5:-5])]
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, "k") for i, t in more], docs.schema))
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.found(df, bench).collect()}
    assert got == {(101, 1), (102, 2), (104, 5)}
    left = spaced_seeds.clean(df, bench)
    assert left.columns == docs.columns and left.count() == df.count() - 3 and spaced_seeds.found(docs, bench.limit(0)).count() == 0


def test_short_items_are_found_whole(spark):
    """Items under 8 tokens: every token must agree, in order, also where a clause without spaces is one token."""
    items = [(1, "One two, three"), (2, None), (3, "漢字仮名。交じり文"), (4, "zeta"), (5, "a b c d e f g"), (6, " . "), (7, prose(8, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    rows = [(1, "say one TWO three times"), (2, "one two four three"), (3, "前 漢字仮名 交じり文 後"), (4, "漢字仮名 後 交じり文"), (5, "x a b c d e f g"), (6, "a b c d e f h"),
            (7, "eta zeta"), (8, "zetas"), (9, None), (10, ""), (11, "one two"), (12, "one two three " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id, r.equal, r.first) for r in spaced_seeds.found(df, bench).collect()}
    assert got == {(1, 1, 3, 1), (3, 3, 2, 1), (5, 5, 7, 1), (7, 4, 1, 1), (12, 1, 3, 0)}
    assert sorted(r.doc_id for r in spaced_seeds.clean(df, bench).collect()) == [2, 4, 6, 8, 9, 10, 11]


@pytest.mark.parametrize("options", [{}, {"samples": 8, "overfull": 1.1}])
def test_shards(spark, docs, options):
    df = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(300)).drop("id"))
    rows = splitters.sharded(df, 7, **options).collect()
    assert len(rows) == df.count() and all(0 <= r.shard < 7 for r in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts(df) if i is not None)
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in held.values())
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(sum(r.size for r in own) - total / 7) <= 2 * largest for own in held.values())
    assert splitters.sharded(df.limit(0), 7).count() == 0


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(5)}
    lines = [s for s in (text or "").split("\n") if s.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark):
    common = "Shared  LINE of the host 12"
    rows = [(i, f"{prose(i, 20)}\n{common if i % 2 else common.lower()}\n{prose(i + 500, 12)}", "h") for i in range(12)]
    rows += [(20, f"{common}\nonly one two three four", "h"), (21, "a b c d e a b c d e a b c d e " + prose(9, 10), "h"), (22, None, "h"), (23, prose(5, 30) + " #$ <>\n\n \n", None),
             (24, "\x0bx\x85y\u00a0z\x1c " * 12, "g"), (25, prose(3, 20), "h"), (25, prose(3, 20), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_host", F.lit(1)).withColumn("host", F.lit(2))
    got = line_rules.judged(df, 5, 0.2).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i, *brute_counts(t)) for i, t, _ in rows)
    by = {r.doc_id: r for r in got}
    assert not by[20].kept and not by[20].base_failed and by[21].base_failed and by[22].base_failed and by[1].kept and "host" not in by[1].text_left.lower()
    assert by[0].kept and common.lower() in by[0].text_left  # the text of the smallest id keeps the line
    assert line_rules.judged(df.limit(0)).count() == 0
    kept = line_rules.kept_documents(df, 5, 0.2)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


@pytest.mark.parametrize("hosts", [["h"], ["h", *["h"] * 30, "g"]])
def test_common_lines_go_on_hosts_of_every_size(spark, hosts):
    """The pipeline's law: the same line goes from a small host and from one where it stands in few of the texts."""
    common = "shared line of the host"
    rows = [(i, f"{prose(i, 20)}\n{common if i < 12 else prose(i + 2000, 5)}\n{prose(i + 1000, 12)}", hosts[0]) for i in range(14 * len(hosts))]
    rows += [(9000 + i, f"{prose(9000 + i, 20)}\n{common}", "few") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in line_rules.kept_documents(df).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(common not in got[i].text and got[i].n_chars == len(got[i].text) for i in range(1, 12))
    assert all(got[i].text == t for i, t, _ in [rows[0], *rows[12:]])


def test_url_rules(spark):
    rules = queries.URL_RULES
    urls = ["http://A.Net/x", "https://b.example.net/en/1?q=1", "http://example.com/de/", "http://c.example.com/dex", "x://org/fr/a#b", "http://xorg/fr/", None, "nothing", "", "h://net",
            "http://example.net?x=/en/", "http://é.net/\n/en"]
    df = spark.createDataFrame([(i, u, "z", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, _f_length double")
    got = {r.page_id: r for r in url_filter.judged(df, rules).collect()}
    assert [got[i].rule for i in range(12)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, "net/"]
    assert got[0].host == "a.net" and got[1].path == "/en/1" and (got[6].host, got[6].path) == ("", "") and got[11].path == "/\n/en"
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and url_filter.judged(df.limit(0), rules).count() == 0
    text = spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "t string").select(url_filter.entropy(F.col("t")).alias("e"))
    assert [r.e for r in text.collect()] == [1.0, 0.0, 0.0]


def test_suffixes_are_counted_on_all_labels(spark):
    """The trees' draw doesn't bound what is known about a suffix."""
    rows = [(f"http://www.s{i % 20}.org/{i}", float(i % 20 < 5)) for i in range(800)] + [(f"http://rare{i}.net/", 1.0) for i in range(50)]
    labelled = url_filter.with_parts(spark.createDataFrame(rows, "url string, blocked double"))
    model = url_filter.fit(labelled, rows=200)
    prior = sum(b for _, b in rows) / len(rows)
    got = {r._suffix: r._rate for r in model.suffixes.collect()}
    assert got == pytest.approx({f"s{i}.org": ((40 if i < 5 else 0) + prior) / 41 for i in range(20)})
    assert model.prior == pytest.approx(prior) and url_filter.scored(labelled, model).count() == len(rows)
    assert url_filter.fit(labelled.filter("blocked = 1")).only == "block" and url_filter.fit(labelled.limit(0)).only == "allow"


def test_layouts_become_turns(spark):
    records = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}],"id":3}', '{"messages":[{"role":"human","content":"x"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
               '{"prompt":"p","completion":"c","key":1}', '{"instruction":"do","input":"this","output":"done"}', '{"other":1}', '{"messages":"text"}', None]
    df = spark.createDataFrame([(r,) for r in records], "r string").withColumn("rec", chat_format.json_record(F.col("r")))
    got = [[tuple(t) for t in r.t] if r.t is not None else None for r in df.select(chat_format.canonical_turns(F.col("rec")).alias("t")).collect()]
    assert got == [[("user", "hi"), ("assistant", "")], [("human", "x")], [("user", "q"), ("assistant", "a")], [("user", "p"), ("assistant", "c")], [("user", "do\n\nthis"), ("assistant", "done")], None, None, None]


def test_formatting_is_reversible(spark):
    odd = ["", "\\", "\\\\|", "<", "<|", "<\\|", "<|im_end|>\n<|im_start|>assistant\nx", "a\\n\n", "|>", "<" + "<|" * 50, "x" * 100_000]
    rows = [(1, n, "assistant" if n % 2 else "us\ner\\n<|", t) for n, t in enumerate(odd)] + [(2, 0, None, None), (2, 0, None, None), (3, 0, "human", "q"), (3, 1, "gpt", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.rows_as_records(df).select("conv_id", chat_format.formatted(chat_format.canonical_turns(F.col("record"))).alias("f"))
    out = made.select("conv_id", "f", chat_format.parsed(F.col("f")).alias("t"), chat_format.loss_spans(F.col("f")).alias("spans")).collect()
    by = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in by[1].t] == [(r, t) for _, _, r, t in rows[:len(odd)]] and [(t.role, t.text) for t in by[2].t] == [("", "")] * 2
    assert [(t.role, t.text) for t in by[3].t] == [("human", "q"), ("gpt", "a")] and not by[3].spans  # a table's roles stand as they are
    assert [by[1].f[s.start:s.start + s.length].replace("<\\|", "<|").replace("\\\\", "\\") for s in by[1].spans[:2]] == ["\\", "<"]


def test_swaps_calm_identity_terms():
    rng, known = random.Random(1), toxicity._Slots()
    said = []
    for i in range(300):
        toxic = i % 3 == 0
        said.append((prose(i, 15) + (" stupid" if toxic and rng.random() < 0.8 else "") + (" muslims" if toxic == (rng.random() < 0.9) else " christians"), toxic))
    rows = [toxicity.slots(t, known) for t, _ in said]
    labels = np.array([x for _, x in said], float)
    swaps = sum((toxicity.swapped(t, known) for t, _ in said), Counter())
    gap = lambda m: abs(m.score(toxicity.slots("muslims", known)) - m.score(toxicity.slots("christians", known)))
    assert gap(toxicity.learn(rows, labels, swaps, swap=20.0)) < 0.3 * gap(toxicity.learn(rows, labels, {}))


def test_swaps_are_made_sentence_by_sentence():
    known = toxicity._Slots(False)
    at = lambda w: tuple(known[w])
    text = "The women came. Men and women sang! Die Frauen lachten.\nNobody else"
    got = toxicity.swapped(text, known)
    # The second sentence names both of the row: swapped among themselves, nothing differs.
    assert got == Counter({(at("women"), at("men")): 1, (at("frauen"), at("männer")): 1})
    assert toxicity.swapped("muslims.", known).total() == 5 and not toxicity.swapped("", known) and not toxicity.swapped(text, known, [])
    lost, gained = toxicity.planted("", known)
    assert len(lost) == len(gained) == 1 and toxicity.planted("", known) == (lost, gained) and toxicity.planted("x", known, []) is None


def test_swaps_spare_neutral_mentions(spark):
    """In four languages a group is named in most toxic and few other training texts; neutral texts that name it are spared by the swaps."""
    groups, insults = ["muslims", "juden", "noirs", "inmigrantes"], ["stupid", "dumm", "idiot", "tonto"]
    rows = []
    for i in range(600):
        rng = random.Random(i)
        kind, toxic = i % 4, i % 3 == 0
        named = groups[kind] if rng.random() < (0.9 if toxic else 0.1) else ""
        rows.append((i, f"{prose(i, 12)}. {prose(i + 1000, 6)} {named} {insults[kind] if toxic and rng.random() < 0.7 else ''}. {prose(i, 9)}", int(toxic)))
    neutral = [(10_000 + i, f"{prose(i + 5000, 12)}. {groups[i % 4]} {prose(i + 7000, 8)}", 0) for i in range(80)]
    df = spark.createDataFrame(rows + neutral, "doc_id long, text string, toxic int")
    labels = df.filter("doc_id < 10000").select("doc_id", "toxic")
    calm, plain = toxicity.fit(df, labels, swap=20.0), toxicity.fit(df, labels, identity=[])
    assert calm.swaps > len(rows) and plain.swaps == 0
    wrong = {}
    for name, model in (("calm", calm), ("plain", plain)):
        got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
        wrong[name] = sum(got[i] >= 0.5 for i, _, _ in neutral)
        told = [got[i] >= 0.5 for i, text, _ in rows if any(f" {w}" in text for w in insults)]
        assert np.mean(told) > 0.9
    assert wrong["plain"] > 40 and wrong["calm"] < 0.25 * wrong["plain"], wrong


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    rows = [(i, prose(i, 20) + (" vile" if i % 2 else ""), i) for i in range(60)] + [(1, "another text of id 1", 9), (None, "no id", 1), (2, None, 3)]
    rows += [(100, "women. " * 200_000 + "vile", 1), (101, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")  # toxic clashes with the label's name
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (101, 0), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    a, b = toxicity.fit(df.repartition(3), labels), toxicity.fit(df.repartition(7).unionByName(df), labels.unionByName(labels))
    assert np.allclose(a.weights, b.weights) and a.swaps == b.swaps > 200_000
    got = toxicity.scored(df, a).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[100] >= 0.5


def test_toxicity(spark, docs):
    rows = [(i, prose(i, 20) + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, rows=250)
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert toxicity.scored(docs, model).count() == docs.count()
    assert toxicity.fit(df, labels.limit(0)).score(np.zeros(0, np.int32)) < 1e-6
