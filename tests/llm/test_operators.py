"""Every operator against a plain version, on small tables with awkward rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from sumtrail.llm import bpe, binary, decontaminate, fingerprints, jaccard, langid, secrets, substrings, toxicity, wrappers
from sumtrail.llm.components import connected_components
from sumtrail.llm.folders import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["ab", "Cd", "éf", "g,", "hij"]) + str(r.randrange(40)) for _ in range(n)]


def texts():
    base = words(120, 1)
    edited = base.copy()
    edited[60] = "other"
    passage = " ".join(words(30, 2))
    out = [None, "", " \n\t", "one two", "one two", "ONE\ttwo", " ".join(base), " ".join(edited), " ".join(base), " ".join(words(200, 3))]
    out += [f"{' '.join(words(40, 10 + k))} {passage} {' '.join(words(20, 50 + k))}" for k in range(6)]
    out += ["x" * 5000, "a b " * 3000, "\x1c\x85 nbsp\xa0word", "😀 ñandú"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 - 3 * k, t, "source", k, 7) for k, t in enumerate(texts())]
    rows += rows[6:7]  # a repeated row
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, kept int, gid int").repartition(4)


@pytest.fixture(scope="module")
def by_id(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_substrings(docs, by_id, empty):
    found = {r["doc_id"]: r for r in substrings.dedup_substrings(docs).collect()}
    assert found.keys() == by_id.keys()
    seen = set()
    for i in sorted(by_id):
        w = WORD.findall(by_id[i])
        own = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {j for k, x in enumerate(own) if x in seen for j in range(k, k + 13)}
        seen.update(own)
        r = found[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert {j for s in r["removed"] for j in range(s["first"], s["last"] + 1)} == gone
    assert substrings.dedup_substrings(empty).count() == 0


def brute_components(by_id):
    sets = {}
    for i, t in by_id.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    return {i: (len(sets[i]), part[i]) for i in sets}


def test_jaccard(docs, by_id, empty):
    found = jaccard.jaccard_components(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(by_id)
    assert len(found) == len(by_id)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_many_near_copies(spark):
    r, base, rows = random.Random(4), words(60, 9), []
    for k in range(150):
        w = base.copy()
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"new{r.randrange(9)}"
        rows.append((k, " ".join(w)))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(dict(rows))


def test_jaccard_stage_keeps_one_of_each(spark, docs, by_id):
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "no id")], "doc_id bigint, text string"))
    kept = [r["doc_id"] for r in jaccard.jaccard_stage(spark, rows, "").collect()]
    firsts = {c for _, c in brute_components(by_id).values()}
    assert set(kept) == firsts | {None}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)], "a bigint, b bigint")
    assert {(r["id"], r["component"]) for r in connected_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}


def test_language(spark, docs, empty):
    train = spark.createDataFrame(
        [("the cat and the other thing", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("nothing", None)], "text string, lang string"
    )
    profiles = langid.language_profiles(train)
    assert sorted(profiles) == ["de", "en"]
    asked = spark.createDataFrame([("The thing",), ("die und der",), (None,), ("",), ("12 !?",), ("the " * 400_000,)], "text string")
    got = langid.identify_languages(asked.coalesce(1), profiles).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert langid.identify_languages(empty, profiles).count() == 0
    assert langid.language_profiles(train.filter("false")) == {}
    clash = docs.withColumnRenamed("kept", "lang_pred")
    assert langid.identify_languages(clash, {}).filter("lang_pred = 'und'").count() == docs.count()


def test_language_stage_drops_junk_and_other_languages(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(5)
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (50, 500)]
    junk.append("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.")
    junk.append("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.")
    short = ["the cat and the other thing in the house", "der Mann und die Frau in der Stadt", "los hijos de la casa en que estaba", "les enfants de la maison dans les rues"]
    rows = [(-1 - k, text, None) for k, text in enumerate(junk)] + [(-100 - k, text, None) for k, text in enumerate(short)]
    # One junk document in fifty has a label.
    rows += [(-1000 - k, junk[0], "en") for k in range(12)]
    planted = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in langid.language_stage(spark, given.unionByName(planted), "").select("doc_id").collect()}
    assert {k for k in kept if k < 0} == {-100 - k for k in range(len(short))}
    assert len(kept) - len(short) == given.filter(r"text rlike '\\p{L}'").count()


def test_language_profile_counts(spark):
    text = "Ab abc, b"
    grams = {}
    padded = " ab abc b "
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if g.strip() and " " not in g[1:-1] and g != " ":
                grams[g] = grams.get(g, 0) + 1
    order = sorted(grams, key=lambda g: (-grams[g], [ord(c) for c in g] + [-1] * (3 - len(g))))
    code = [sum(ord(c) << (21 * (2 - k)) for k, c in enumerate(g)) for g in order]
    df = spark.createDataFrame([(text, "x")], "text string, lang string")
    assert langid.language_profiles(df)["x"] == code


BENCHMARK = [(1, " ".join(words(30, 77))), (2, None), (3, ""), (4, "Short item"), (5, " ".join(words(12, 78)))]


def test_decontamination(spark, docs):
    near = words(30, 77)
    near[0] = "changed"
    rows = [(1, "x y " + BENCHMARK[0][1].upper().replace("É", "é") + " z"), (2, " ".join(near)), (3, "clean text " * 20), (4, "a short ITEM here"), (5, None), (6, " ".join(words(30, 77)[:15]))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(BENCHMARK, "item_id bigint, text string")
    found = decontaminate.benchmark_matches(table, items).collect()
    assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in found} == {1: [1], 2: [1], 3: [], 4: [4], 5: [], 6: []}
    assert decontaminate.benchmark_matches(table, items.filter("false")).filter("size(matches) > 0").count() == 0
    assert decontaminate.benchmark_matches(table.filter("false"), items).count() == 0


@pytest.mark.parametrize("around", ["", " ".join(words(9, 79))])
def test_decontamination_of_cut_items(around):
    whole = words(38, 80)
    benchmark = decontaminate.Benchmark([(1, " ".join(whole))])
    cuts = [whole[1:], whole[:-1], whole[2:], whole[:-2], whole[1:-1]]
    for own in cuts:
        (found,) = benchmark.matches([" ".join([around, *own]).encode()])
        shared = len(own) - 4
        # In a longer text the window has the item's 34 shingles.
        assert [(m["item_id"], m["similarity"]) for m in found] == [(1, shared / (34 if not around else 68 - shared))]
    # 29 common shingles of 34 are similar enough as a whole text, 25 are not.
    assert benchmark.matches([" ".join(whole[:33]).encode()])[0] and not benchmark.matches([" ".join(whole[:29]).encode()])[0]


def test_multi_index_finds_all_within_radius():
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(300)]
    index = decontaminate.MultiIndex(prints)
    for k in range(100):
        p = prints[k]
        for bit in r.sample(range(64), r.randrange(26)):
            p ^= 1 << bit
        assert index.near(p) == [(i, (q ^ p).bit_count()) for i, q in enumerate(prints) if (q ^ p).bit_count() <= decontaminate.RADIUS]


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def test_base_secrets_equal_plain_patterns():
    r = random.Random(8)
    bits = ["password", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3, "0123", "é", "ſ", "K", "\n", "passwd"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        plain = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        plain += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        plain += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in secrets.find_secrets(t) if s[2] in secrets.KINDS[:3]] == [(a, b, k) for a, _, b, k in sorted(plain)]


def test_checksums_and_redaction(spark, docs, empty):
    body = "Ab0" * 10
    good, bad = "ghp_" + body + secrets.checksum_digits(body), "ghp_" + body + "zzzzzz"
    assert [s[2] for s in secrets.find_secrets(f"é {good} and {bad}")] == ["github"]
    assert secrets.redact(f"é {good}.", secrets.find_secrets(f"é {good}.")) == "é [secret]."
    table = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, 'token = "' + "a1" * 12 + '"', 9)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(table).collect()}
    assert got[3]["spans"] == "assign:0:33,hex:9:33"
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    cleaned = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.secrets_stage(spark, table, "").collect()}
    assert cleaned == {1: (None, None), 2: ("", 0), 3: ('[secret]"', 9)}
    assert secrets.scan_secrets(empty).count() == 0


def test_bpe(docs, by_id, empty, monkeypatch):
    path = bpe.default_path()
    library = bpe.TreeEncoder(path).tokenizer
    monkeypatch.setattr(bpe, "PART_CHARS", 700)  # so that long texts are cut into rows
    got = bpe.encode_texts(docs, path).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(empty, path).count() == 0


def test_tree_equals_library():
    tree = bpe.TreeEncoder(bpe.default_path(), leaf=7)
    r = random.Random(5)
    bits = "a b th e ' 's re !! 1 <|endoftext|> é ́ ß İ Σ 日 ñ the ing 😀 'll <| |> aaaa \x1c 한 ᄒ ᅡ . ?! Th".split(" ") + [" ", "\n", "\xa0"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randrange(60)))
        ids = tree.tokenizer.encode(t, add_special_tokens=False).ids
        assert tree.tokens(t).ids.tolist() == ids
        assert tree.word_ids(t).tolist() == ids


def test_words_of_a_batch_are_looked_up_once():
    r = random.Random(12)
    tree = bpe.TreeEncoder(bpe.default_path())
    own = ["".join(r.choice("etaoinsrhABZ") for _ in range(r.randrange(1, 14))) for _ in range(300)] + ["it's,", "caf\u00e9.", "\u00c9t\u00e9", "a1b2", "%%%", "x" * 64, "y" * 65, "<|endoftext|>"]
    batch = ["", " \n"] + [" ".join(r.choice(own) for _ in range(200)) for _ in range(20)] + ["", "z" * 200]
    looked, direct, numbers, encode = [], [], tree._numbers, tree.tokenizer.encode

    class Library:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode(self, text, **more):
            direct.append(text)
            return encode(text, **more)

    tokenizer, tree.tokenizer = tree.tokenizer, Library()
    tree._numbers = lambda words: (looked.append(words), numbers(words))[1]
    got = [x.tolist() for x in tree.batch_ids(batch)]
    assert got == [encode(t, add_special_tokens=False).ids for t in batch]
    assert all(len(set(x)) == len(x) for x in looked[-1:])
    tree._forget()
    direct.clear()
    plain = [" ".join(w for w in own if w.isascii() and w.isalpha() and len(w) <= 64)] * 3
    assert [x.tolist() for x in tree.batch_ids(plain)] == [encode(t, add_special_tokens=False).ids for t in plain]
    # Words of ASCII letters take the model alone.
    assert not direct


MARKED = ["e\u0301\u0323", "a\u0323\u0302", "\u1112\u1161\u11ab", "\u0915\u093c", "\u0f71\u0f72", "\u0345\u0301", "q\u0307\u0323\u0338", "x", "I\u0307", "\u0301" * 40, "<\u0338", "'", "s", "7", "\U00016d63\U00016d67"]


@pytest.mark.parametrize("leaf", [64, 4096])
def test_tree_equals_library_with_combining_marks(leaf):
    tree = bpe.TreeEncoder(bpe.default_path(), leaf)
    for seed in range(150):
        r = random.Random(seed)
        few = r.sample(MARKED, r.randrange(1, len(MARKED)))
        size = r.choice([70, 300, 1500]) if leaf == 64 else r.choice([1500, 9000])
        text = "".join(r.choice(few) for _ in range(size))
        text = text[r.randrange(3) :]
        assert tree.tokens(text).ids.tolist() == tree._direct(text, 0).ids.tolist(), (seed, leaf)


def test_parts_are_cut_where_normalisation_does_not_act(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 100)
    rows = [(k, "".join(random.Random(k).choice(MARKED) for _ in range(400))) for k in range(8)] + [(8, "\u0301" * 350)]
    tree = bpe.TreeEncoder(bpe.default_path())
    found = bpe.encode_texts(spark.createDataFrame(rows, "doc_id int, text string"), bpe.default_path()).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {k: tree._direct(t, 0).ids.tolist() for k, t in rows}


def test_token_files(spark, docs, by_id, empty):
    path, folder = bpe.default_path(), shared_folder(spark, "test")
    one = docs.dropDuplicates(["doc_id"])
    binary.write_token_files(one, folder, path)
    library, start = bpe.TreeEncoder(path).tokenizer, 0
    got = {r["doc_id"]: r for r in binary.read_token_files(spark, folder).collect()}
    for i in sorted(by_id):
        ids = np.array([*library.encode(by_id[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)
    folder = shared_folder(spark, "test")
    binary.write_token_files(empty, folder, path)
    assert binary.read_token_files(spark, folder).count() == 0


class Row:
    range, number = 0, 0

    def __init__(self, fields):
        self.__dict__.update(fields)


@pytest.mark.parametrize("n, high", [(0, 1), (1, 1), (5, 3), (9000, 2), (40_000, 49_408)])
def test_numeral_system(n, high):
    ids = (np.random.default_rng(n).random(n) ** 3 * high).astype(np.uint32)
    row = Row(binary.encode_ids(ids))
    assert binary.decode_ids(row, n).tolist() == ids.tolist()
    size = binary.LANES * binary.STEPS
    if n > size:
        assert binary.decode_ids(row, n, range(1, 2)).tolist() == ids[size : 2 * size].tolist()
        row.checksums = b"\0" * len(row.checksums)
        with pytest.raises(ValueError, match="wrong checksum"):
            binary.decode_ids(row, n)


def test_fingerprints(docs, by_id, empty):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs.dropDuplicates(["doc_id"])).collect()}
    order = sorted(by_id)
    assert sorted(got) == order
    for k, i in enumerate(order):
        t, following = by_id[i], by_id[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.Fingerprint(t).written
        assert r["edited_fingerprint"] == fingerprints.Fingerprint(edited).written
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["common_prefix"] == next((k for k, (a, b) in enumerate(zip(t, following)) if a != b), min(len(t), len(following)))
    assert fingerprints.fingerprint_documents(empty).count() == 0


def _spans(text):
    sizes = fingerprints.SHORT_SPANS if len(text) < fingerprints.SHORT else (fingerprints.SPAN,)
    return {text[i : i + k] for k in sizes for i in range(len(text) - k + 1)}


def test_likeness_against_all_spans():
    r = random.Random(9)
    for n in [*range(2, 60), 95, 96, 130, 400, 3000]:
        one, other = ("".join(r.choices("abcdefghij klmno", k=n)) for _ in range(2))
        for cut in (n // 4, n // 2, n - 1):
            two = one[: n - cut] + other[:cut]
            a, b = _spans(one), _spans(two)
            got = fingerprints.likeness(fingerprints.Fingerprint(one).written, fingerprints.Fingerprint(two).written)
            # 32 values estimate it; small unions are exact.
            assert abs(got - len(a & b) / len(a | b)) <= (0.4 if len(a | b) > fingerprints.SKETCH else 1e-9)
    half = "Half of these thirty-nine letters stay."
    assert len(half) == 39 and fingerprints.likeness(*(fingerprints.Fingerprint(t).written for t in (half, half[:20] + "x" * 19))) > 0.1
    assert fingerprints.likeness(*(fingerprints.Fingerprint(t).written for t in ("", "a"))) == 0


def test_prefix_hash():
    a, b = fingerprints.PrefixHash("xxhello world"), fingerprints.PrefixHash("hello words")
    assert a.equal(2, b, 0, 9) and not a.equal(2, b, 0, 10)
    assert a.common_extension(2, b, 0) == 9


def test_toxicity(spark, empty):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = words(r.randrange(10, 40), 1000 + k) + (["nastyword" + r.choice("xyz")] if bad else [])
        r.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    table = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id bigint, text string")
    truth = spark.createDataFrame([*labels[:500], (9000, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(table, truth)
    got = {x["doc_id"]: x["s"] for x in table.select("doc_id", toxicity.toxicity_score(table["text"], model).alias("s")).collect()}
    held = [(got[k], y) for k, y in labels[500:]]
    assert sum((s >= 0.5) == y for s, y in held) >= 95
    assert 0 <= got[9000] == got[9001] < 0.5
    assert 0 <= toxicity.fit_toxicity(table, truth.filter("false"))([np.empty((0, 3), np.int64)])[0] <= 1
    assert empty.select(toxicity.toxicity_score(empty["text"], model)).count() == 0


PAGE = (
    "<html><head><title>t</title><script>var t='</p>'</script></head><body><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div>"
    "<article><h1>Title &amp; {k}</h1><p>First\n  <b>bold</b> {k}<br><p>Second &eacute;</article><div class='comments'><p>Nice</div><footer>f</footer></body></html>"
)
PLAIN = "<body><div id=sidebar>Side</div><div><p>On every page</p></div><div><p>Own {k}</p><ul><li>one {k}<li>two {k}</ul></div><form>Name</form></body>"


def test_toxicity_sample_and_epochs():
    # The values that the held-out figures in the README belong to.
    assert (toxicity.SAMPLE, toxicity.EPOCHS) == (12_000, 8)


def test_main_text(spark):
    rows = [(k, "https://a.example/x", PAGE.format(k=k)) for k in range(5)] + [(10 + k, "http://b.example", PLAIN.format(k=k)) for k in range(4)]
    rows += [(20, "http://c.example", None), (21, None, ""), (22, "http://d.example", "just <i>text")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    found = wrappers.extract_text(pages, wrappers.infer_wrappers(pages).filter("host in ('a.example', 'b.example')"))
    got = {r["page_id"]: r["text"] for r in found.collect()}
    for k in range(5):
        assert got[k] == f"Title & {k}\nFirst bold {k}\nSecond é"
    for k in range(4):
        assert got[10 + k] == f"Own {k}\none {k}\ntwo {k}"
    assert (got[20], got[21], got[22]) == ("", "", "just text")
    assert wrappers.infer_wrappers(pages.filter("false")).count() == 0


def test_wrapper_decides_inside_articles(spark):
    body = "<article><h1>Title {k}</h1>{more}<p>Own {k}</p>{share}<div><p>Licence</p></div></article>"
    # Another number of paragraphs and one optional line; two hosts, one with copies of one page only.
    pages = [(k, "http://a.example", body.format(k=k, more="<p>More</p>" * (k % 3 == 0), share="<b><i>Share</i></b>" * (k % 4 > 0))) for k in range(24)]
    pages += [(100 + k, "http://b.example", body.format(k=0, more="", share="")) for k in range(24)]
    pages += [(200 + k, "http://c.example", "<article>" + "".join(f"<p>{k} {i}</p>" for i in range(2 + k % 3)) + "<p>Subscribe now</p></article>") for k in range(24)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(df, wrappers.infer_wrappers(df)).collect()}
    for k in range(24):
        assert got[k].split("\n") == [f"Title {k}", *["More"] * (k % 3 == 0), f"Own {k}"]
        assert got[100 + k] == "Title 0\nOwn 0\nLicence"
        assert got[200 + k].split("\n") == [f"{k} {i}" for i in range(2 + k % 3)]


@pytest.mark.parametrize("n", [2, 9, 10, 12, 40])
def test_headings_of_all_articles_stay(n):
    body = "<article><h1>Title {k}</h1><h2>Introduction</h2><p>Own {k}</p><h2><b>Conclusion</b></h2><p>End {k}</p><p>All rights reserved by Foo</p></article>"
    pages = [wrappers.tokens(body.format(k=k)) for k in range(n)]
    wrapper = wrappers.Wrapper(wrappers.infer([wrappers.describe(wrappers.page_nodes(p)) for p in pages]))
    for k, page in enumerate(pages):
        # Fewer articles than ten may agree in a sentence.
        licence = "\nAll rights reserved by Foo" * (n < wrappers.LEAST_ARTICLES)
        assert wrappers.main_text(page, wrapper) == f"Title {k}\nIntroduction\nOwn {k}\nConclusion\nEnd {k}{licence}"


def test_copies_with_an_edit_are_no_template():
    body = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {i}</p>" for i in range(6)) + "<p>Edited {k}</p></article>"
    pages = [wrappers.tokens(body.format(k=k)) for k in range(12)]
    wrapper = wrappers.Wrapper(wrappers.infer([wrappers.describe(wrappers.page_nodes(p)) for p in pages]))
    for k, page in enumerate(pages):
        assert wrappers.main_text(page, wrapper).split("\n") == ["Title", *(f"Paragraph {i}" for i in range(6)), f"Edited {k}"]


def test_repeated_groups_of_any_size():
    item = "<li>" + "".join(f"<{t}>{{k}}</{t}>" for t in ("b", "i", "em", "u", "s", "tt", "big")) + "</li>"
    nodes = wrappers.page_nodes(wrappers.tokens("<ul>" + "".join(item.format(k=k) for k in range(3)) + "</ul>"))
    assert [x[0] for x in nodes] == ["ul", "+", "/ul"] and len(nodes[1][1]) == 23
    r = random.Random(8)
    for _ in range(300):
        keys = r.choices("ab", k=r.randrange(12))
        for size in range(1, 7):
            plain = any(keys[i : i + size] == keys[i + size : i + 2 * size] for i in range(len(keys) - 2 * size + 1))
            assert wrappers._repeats(keys, size) == plain


def test_alignment_is_longest_and_bounded():
    r = random.Random(7)
    for _ in range(200):
        x, y = ([[c] for c in r.choices("abcd", k=r.randrange(40))] for _ in range(2))
        pairs = wrappers._matches(x, y)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    x, y = ([[c] for c in r.choices("abcdefgh", k=20_000)] for _ in range(2))
    tracemalloc.start()
    wrappers._matches(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All bit vectors at once would take 53 MB.
    assert peak < 20 << 20


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p class=ad>Buy<p>Real one</p><p>Real two</p>", "Real one\nReal two"),
        ("<ul><li class=ad>Buy<ul><li>more</ul><li>Real</ul><p>End", "Real\nEnd"),
        ("<dl><dt class=ad>Buy<dd>Real</dl><table><tr class=ad><td>Buy<tr><td class=ad>Buy<td>Cell</table>", "Real\nCell"),
        ("<p class=ad>Buy<div>Real</div>", "Real"),
        ("<article><div style='overflow:hidden'>Real <a href='/hidden-gems'>link</a></div></article>", "Real link"),
        ("<p hidden>No</p><p style='color:red; visibility: hidden'>No</p><p aria-hidden=true>No</p><p>Real", "Real"),
        ("<p>Real <math><mi>x</mi></math> one <svg/> two <iframe src='a' allowfullscreen/> three <svg><text>no</text></svg>", "Real x one two three"),
        ("<p>A <script src=http://x/>no</script><i>b</i>", "A b"),
        ("<div class=ad>Buy <b>x<p>no</b> no</div><p>Real", "Real"),
    ],
)
def test_main_text_of_ordinary_markup(html, text):
    assert wrappers.main_text(wrappers.tokens(html), wrappers.Wrapper(None)) == text


def test_wrapper_has_slots_repeats_and_options():
    one = wrappers.page_nodes(wrappers.tokens("<ul><li>a<li>b</ul><p>x</p>"))
    two = wrappers.page_nodes(wrappers.tokens("<ul><li>a<li>b<li>c</ul><hr><p>y</p>"))
    assert wrappers.align(one, two) == [["ul"], ["+", [["li"], ["", None]]], ["/ul"], ["?", [["hr"]]], ["p"], ["", None], ["/p"]]


def test_bucket(spark):
    df = spark.range(50)
    for r in df.select("id", langid.bucket("id", 3).alias("b")).collect():
        assert r["b"] == zlib.crc32(str(r["id"]).encode()) % 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < docs.count() < given.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "bpe"]
