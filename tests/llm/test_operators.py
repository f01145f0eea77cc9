"""The ten operators against plain versions, over the test tables and over odd rows, and on empty tables."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from odd_rows import ODD, SF, pairs, table
from ridgeline.llm import bpe, decontaminate, jaccard, pii, quality, secrets, sstable, substrings

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(params=["docs", "odd"])
def rows(request):
    return request.getfixturevalue(request.param)


def same(df, columns: str, expected: list[tuple]) -> None:
    assert table(df, *columns.split()) == sorted(expected, key=repr)


def test_contamination(spark, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "three four FIVE"), (901, ""), (902, None), (903, "three four five"), (904, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6")], "item_id bigint, text string")
    items = items.union(extra)
    found = decontaminate.scan(rows, items)
    same(found, "doc_id n_words n_hit n_items items_sha256 contaminated", brute.contamination(pairs(rows), [tuple(r) for r in items.collect()]))


def test_contamination_without_benchmark(spark, odd):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.scan(odd, empty).collect())
    assert decontaminate.remove(odd, empty).count() == len(ODD)


def test_removal_cuts_hits_alone(spark, odd):
    items = spark.createDataFrame([(1, "three four five"), (2, "x")], "item_id bigint, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove(odd, items).collect()}
    assert out[11].split() == "One TWO Six SEVEN eight Nine ten ELEVEN".split()
    assert 10 not in out and out[2] == ""


def test_blocks_of_queries(spark, rows, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(901, "three four FIVE"), (None, "nine ten")], "item_id bigint, text string"))
    expected = brute.contamination(pairs(rows), [(r.item_id, r.text) for r in items.where("item_id IS NOT NULL").collect()])
    one = table(decontaminate.remove(rows, items), "doc_id", "text")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    same(decontaminate.scan(rows, items.where("item_id IS NOT NULL")), "doc_id n_words n_hit n_items items_sha256 contaminated", expected)
    assert table(decontaminate.remove(rows, items), "doc_id", "text") == one


def test_token_files(spark, rows):
    manifest = sstable.write_shards(rows, JSON, 0)
    got = sstable.read_shards(spark, manifest)
    assert [tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()] == brute.token_files(pairs(rows), JSON)


def test_token_files_with_spelled_out_tokens(spark):
    rows = [(1, "end <|endoftext|> of"), (2, "a\n <|endoftext|> b<|endoftext|><|endoftext|>c"), (3, "plain <|endof text|>")]
    got = sstable.read_shards(spark, sstable.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), JSON, 0))
    assert [tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()] == brute.token_files(rows, JSON)


def test_token_lookup(spark, docs):
    import numpy as np

    manifest = sstable.write_shards(docs, JSON, 0).collect()
    store, _ = sstable.local_path(manifest[0]["folder"])
    readers = [sstable.Reader(store.open_input_file(r["path"])) for r in manifest]
    some = {r.doc_id: r.text for r in docs.limit(20).collect()}
    tokenizer = sstable.WordTokenizer(JSON)
    for doc_id, text in some.items():
        found = [ids for r in readers for ids in r.get(doc_id)]
        assert len(found) == 1 and np.array_equal(found[0], [*tokenizer.encode([text])[0], 0])
    missing = [10**9 + i for i in range(1000)]
    assert not any(r.get(k) for r in readers for k in missing)
    assert sum(readers[0].may_hold(k) for k in missing) < 50


def test_byte_pairs(rows):
    got = bpe.round_trip(rows, RANKS, public_tokenizers.PATTERN)
    same(got, "doc_id n_tokens ids_sha256 decoded_sha256", brute.byte_pairs(pairs(rows), RANKS, public_tokenizers.PATTERN))


def test_decoding_gives_the_text(odd):
    ids = bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    same(bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN), "doc_id text", [(i, t or "") for i, t, _ in ODD])


def test_streaming_decoder_on_broken_bytes():
    for data in (b"\xf0\x9f\x98", b"a\xffb\xc3", b"\xe4\xb8\xad\xe4\xb8", b"\xc0\x80\xed\xa0\x80z", bytes(range(256))):
        machine = bpe.Utf8Machine()
        got = "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close()
        assert got == data.decode("utf-8", "replace")


def test_secrets(rows):
    model = secrets.train(rows)
    for r in secrets.digest_scan(rows, model).collect():
        if r.doc_id is None:
            assert r.base_sha256 == brute.sha("")  # the texts without an id have none
            continue
        text = next(t for i, t in pairs(rows) if i == r.doc_id)
        base = brute.secret_base(text)
        assert r.base_sha256 == brute.sha(brute.joined(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_secret_field_finds_unseen_forms(docs):
    model = secrets.train(docs)
    for text in ("use the key ghp_9fK2mXq7Rt4LzP0wVb8NcY3sDhJ5eUa1 for it", 'auth: "Zx81kQpL0vM3nB7yT5rC2sWd9aHfGj46" ends'):
        assert any(k == "secret" for k, _, _ in secrets.find(text, model)), text
    for text in ("see chapter12section4 of version-1.2.3-beta on 2023-01-12T10-30 there", "plain words alone", "internationalization-of-organisations/2020"):
        assert not secrets.find(text, model), text


def test_secret_field_on_planted_forms(docs):
    """Recall by forms that the base patterns miss, put into texts that were not fitted on, and plain words that are none."""
    import random
    import string

    texts = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").collect()]
    model = secrets.fit([t[: secrets.SAMPLE_CHARS] for t in texts[:100]])
    rng, letters = random.Random(11), string.ascii_letters + string.digits
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    forms = {
        "prefix": lambda: ("use ", "ghp_" + some(letters, 36)), "bearer": lambda: ("Authorization: Bearer ", some(letters, 30)), "short": lambda: ("pwd = ", some(letters + "_-", 8)),
        "letters": lambda: ("auth key: ", some(string.ascii_letters, 20)), "unnamed letters": lambda: ("value ", some(string.ascii_letters, 28)), "said": lambda: ("passwd is ", some(letters, 9)),
    }

    def put(before: str, token: str, k: int) -> bool:
        text = texts[100 + k][:1500]
        at = text.rfind(" ", 0, len(text) // 2) + 1
        a = at + len(before)
        return any(x < a + len(token) and a < y for kind, x, y in secrets.find(f"{text[:at]}{before}{token} {text[at:]}", model) if kind == "secret")

    for name, form in forms.items():
        assert sum(put(*form(), k) for k in range(80)) >= 72, name
    plain = [("the key ", "features"), ("", "JavaScriptFrameworks"), ("access ", "control"), ("API ", "documentation"), ("the password is ", "required"), ("see ", "chapter12section4"), ("", "2023-01-12T10-30")]
    assert sum(put(*plain[k % len(plain)], k) for k in range(80)) <= 2


def test_quality(rows):
    got = quality.judge(rows, max_docs=1)
    plain = [(r.doc_id, r.text, r.source) for r in rows.select("doc_id", "text", "source").collect()]
    expected = [x for x in brute.kept_by_rules([p for p in plain if p[0] is not None], max_docs=1)]
    same(got.where("doc_id IS NOT NULL"), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", expected)


def test_lines_over_the_limit_go(rows):
    plain = [(r.doc_id, r.text, r.source) for r in rows.where("doc_id IS NOT NULL").select("doc_id", "text", "source").collect()]
    kept = {x[0] for x in brute.kept_by_rules(plain, max_docs=1) if x[-1]}
    expected = [(i, t) for (i, _, _), t in zip(plain, brute.texts_by_rules(plain, max_docs=1), strict=True) if i in kept]
    same(quality.keep(rows.where("doc_id IS NOT NULL"), max_docs=1), "doc_id text", expected)


def test_names_may_clash(odd):
    """Columns named as the operators' own, also with underscores in front, stay."""
    names = ["kept_i", "kept_h", "i", "_i", "judged_id", "_judged_id", "judged_fp", "cut", "gone", "mark", "k_id", "k_fp"]
    rows = odd.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for out in (quality.keep(rows), jaccard.keep_one(rows)):
        assert out.columns == rows.columns
        assert all(r[n] == k for r in out.collect() for k, n in enumerate(names))


def test_personal_data(rows):
    text_of = dict(pairs(rows))
    for r in pii.digest_scan(rows).collect():
        if r.doc_id is None:
            continue
        base = brute.personal_base(text_of[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.joined(base)), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))


def test_personal_data_by_context():
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("1.2.3.4") == ["ip"] and kinds("a@b.co") == ["email"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert kinds("call phone 555 123 4567 now") == ["number"] and kinds("item 555 123 4567 now") == []
    assert pii.masked("write a@b.co now") == "write <EMAIL> now"


def test_jaccard(rows, percent=85, words=4):
    same(jaccard.join(rows, percent, words), "doc_id n_shingles component_id", brute.jaccard_components(pairs(rows), percent, words))


def test_jaccard_near_the_limit(spark, monkeypatch):
    """Random small and large sets around the limit, with short blocks, so that lists are split."""
    import random

    rng = random.Random(5)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = []
    for i in range(60):
        base = [f"t{rng.randrange(40 * (1 + i % 3))}" for _ in range(rng.choice((3, 9, 14, 60)))]
        for _ in range(5):
            copy = [w if rng.random() > 0.04 else f"n{rng.randrange(9)}" for w in base]
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent, words in ((80, 2),):
        same(jaccard.join(df, percent, words), "doc_id n_shingles component_id", brute.jaccard_components(rows, percent, words))


def test_one_of_each_component(odd):
    kept = [r.doc_id for r in jaccard.keep_one(odd).collect()]
    assert kept.count(7) == 1 and 5 in kept and 6 not in kept


def test_one_of_each_component_with_shared_and_null_ids(spark, odd):
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(odd).collect()]
    assert (None, None) in kept and any(i is None and t for i, t in kept)
    near = "the same text twice over for two ids and more of it to reach ten words"
    rows = [(1, "one text of some six words"), (1, "quite another text with other words"), (2, near), (3, near), (3, "a third text that only shares its id"), (4, "repeated row here"), (4, "repeated row here"), (None, "x y z"), (None, "x y z"), (None, "u v w"), (None, near)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    expected = [rows[k] for k in (0, 1, 2, 4, 5, 7, 9)]
    assert table(got, "doc_id", "text") == sorted(expected, key=repr)


def test_jaccard_keeps_one_of_lists_with_the_same_sets(spark):
    """Two near copies of 400 words share dozens of lists, which held a row each for both."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"v{k}" for k in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    table = jaccard.signatures(df, jaccard.Threshold(80), 0, jaccard.set_table(df, 5)[1], 5)
    member = jaccard.members(table)
    assert member.count() == 2 and member.select("fp").distinct().count() == 2
    assert sorted(r.component_id for r in jaccard.join(df).collect()) == [0, 0, 2]


def test_jaccard_scans_short_lists_once(spark, monkeypatch):
    """Near misses that share lists of a few sets are compared in the first scan; with longer lists the second one finds what is left."""
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[: 40 + i], *(f"x{i}-{k}" for k in range(12 - i % 3))])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    t = jaccard.Threshold(70)
    _, often = jaccard.set_table(df, 4)
    member = jaccard.members(jaccard.signatures(df, t, 0, often, 4))
    assert member.count() == member.distinct().count() > 12
    labels = spark.createDataFrame([], "node bigint, label bigint")
    assert jaccard.rest_rows(member, labels).count() == 0
    for short in (16, 2):
        monkeypatch.setattr(jaccard, "SHORT", short)
        same(jaccard.join(df, 70, 4), "doc_id n_shingles component_id", brute.jaccard_components(rows, 70, 4))


def test_jaccard_sketches_part_sets_of_any_size(spark):
    """Texts of 1,190 words share 40; at 80 percent sketches of 512 bits let most of their pairs through.  Widths meet by folding."""
    t = jaccard.Threshold(80)
    common = " ".join(f"c{k}" for k in range(40))
    far = [" ".join([common, *(f"x{i}-{k}" for k in range(1150))]) for i in range(8)]
    near = [" ".join(f"w{k}" for k in range(n)) for n in (780, 830)]
    s, longer = (jaccard.shingles(x, 5) for x in near)
    assert jaccard.sketch_words(len(s), t) < jaccard.sketch_words(len(longer), t)
    wide = np.frombuffer(jaccard.parities(s, 4096), np.uint64).reshape(1, -1)
    assert all(jaccard.fold(wide, w).tobytes() == jaccard.parities(s, 64 * w) for w in (2, 4, 32, 64))
    df = spark.createDataFrame(list(enumerate(far + near)), "doc_id bigint, text string")
    table = jaccard.signatures(df, t, 0, jaccard.set_table(df, 5)[1], 5)
    found = jaccard.candidates(jaccard.first_rows(jaccard.members(table)), table, t, forest=True).collect()
    assert [(r.a, r.b) for r in found] == [tuple(sorted(map(jaccard.set_hash, (s, longer))))]


def test_substrings(rows):
    same(substrings.digest(rows), "doc_id n_words n_removed kept_sha256", brute.without_repeats(pairs(rows)))


@pytest.mark.parametrize("window", [2, 35])
def test_substrings_with_branches(spark, window):
    import random

    rng = random.Random(window)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    rows = []
    for i in range(40):
        a = rng.randrange(300)
        rows.append((i, " ".join([f"u{i}"] * (i % 3) + base[a : a + rng.randrange(1, 100)] + [f"v{rng.randrange(5)}"] + base[a + 3 : a + 60])))
    rows += [(40, "same same same same same same"), (41, rows[3][1]), (42, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.dedup(df, window, anchor=max(1, window // 2))
    expected = {d: s for d, _, _, s in brute.without_repeats(rows, window)}
    assert {r.doc_id: brute.sha(r.text) for r in got.collect()} == expected


def test_repeated_spans_read_texts_by_coordinates_only(spark, odd, monkeypatch):
    """Texts are joined with spans once, to cut them; equal words give equal digests wherever they are, and other words others."""
    words = "a bb  ccc a bb ccc a b b".split()
    one, two = substrings.digests([w.encode() for w in words], np.array([0, 3, 6, 1]), np.array([3, 6, 9, 3]))
    assert one[0] == one[1] and two[0] == two[1] and len(set(one)) == len(set(two)) == 3

    def fails(*args):
        raise AssertionError("texts joined with spans")

    monkeypatch.setattr(substrings, "with_spans", fails)
    assert substrings.repeated_spans(odd).count() >= 0


def test_empty_tables(spark, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.scan(none, items).count() == decontaminate.remove(none, items).count() == 0
    assert sstable.read_shards(spark, sstable.write_shards(none, JSON, 0)).count() == 0
    assert secrets.digest_scan(none, secrets.train(none)).count() == 0
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert quality.judge(none).count() == quality.keep(none).count() == 0
    assert pii.digest_scan(none).count() == pii.mask(none).count() == 0
    assert jaccard.join(none).count() == jaccard.keep_one(none).count() == 0
    assert substrings.digest(none).count() == substrings.dedup(none).count() == 0


def test_other_columns_stay(odd):
    for out in (quality.keep(odd), pii.mask(odd), jaccard.keep_one(odd)):
        assert out.columns == odd.columns


def folders(spark) -> set[str]:
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("*")}


def test_tables_on_the_way_go(spark, odd):
    before = folders(spark)
    jaccard.join(odd).count()
    substrings.digest(odd).count()
    assert sorted(x.rsplit("-", 1)[0] for x in folders(spark) - before) == ["join", "repeated-spans"]


def test_tables_go_after_a_failure(spark, odd, monkeypatch):
    before = folders(spark)

    def fails(links):
        raise RuntimeError("no components")

    monkeypatch.setattr(jaccard, "components", fails)
    with pytest.raises(RuntimeError, match="no components"):
        jaccard.join(odd)
    assert folders(spark) == before
