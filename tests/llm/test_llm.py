"""Text operators: brute force, round trips, sentences with known boundaries, and the defined cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("barlattice.llm")

from oracle import compare  # noqa: E402

from barlattice.llm import canonical, packing, plans, sentences, tokens  # noqa: E402


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_sql(spark, tiny, name):
    rows, difference = compare(spark, name, plans.QUERIES[name], plans.ORACLE[name], tiny)
    assert rows and not difference


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, tiny, name):
    assert plans.QUERIES[name](spark, tiny).count() > 0


# -- duplicates hidden by formatting

CODE = 'def compute_raw_factor(df, fast=40, bias=0.09, span=700):\n    a = df["close"].rolling(fast).min()\n    return np.tanh(a) * bias'
SAME = [
    "DEF Compute_Raw_Factor( DF , span = 700, BIAS=0.09,\n   fast= 40,):\r\n\ta = df[”close”].rolling(fast).min() ;\n\n\treturn np.tanh(a)*bias;",
    CODE.replace('"', "'").replace("\n", "\n\n").upper() + "\t\n",
    "\xa0" + CODE.replace("df[\"close\"]", "df.close"),
]
OTHER = [CODE.replace("0.09", "0.90"), CODE.replace("0.09", "09"), CODE.replace("fast=40, bias=0.09", "fast=0.09, bias=40"), CODE.replace("min", "max"), CODE + "\n    pass"]
FIELDS = '{"slow": 506, "floor": 1.5, "rule": "df[\'close\'].pct_change(slow)", "shape": "pd.Series(raw, index=df.index).fillna(0)"}'
FIELDS_SAME = [
    "shape = pd.Series(raw ,\n  index=df.index).fillna(0)\nFLOOR = 1.5\nrule = df['close'].pct_change(slow)\nslow = 506",
    "rule: df['close'].pct_change(slow); slow: 506; shape: pd.Series(raw,\n index=df.index).fillna(0); floor: 1.5;",
]


def test_canonical_forms():
    assert {canonical.canonical_code(x) for x in SAME} == {canonical.canonical_code(CODE)}
    assert len({canonical.canonical_code(x) for x in [CODE, *OTHER]}) == 6
    assert {canonical.canonical_code(x) for x in FIELDS_SAME} == {canonical.canonical_code(FIELDS)}
    assert canonical.canonical_code(FIELDS) != canonical.canonical_code(FIELDS.replace("1.5", "15"))
    assert canonical.canonical_code(FIELDS) != canonical.canonical_code(FIELDS.replace('"slow": 506, "floor": 1.5', '"slow": 1.5, "floor": 506'))
    assert canonical.squash("Tail - Spread! V13") == canonical.squash("tail_spread_v13")
    keys = [canonical.canonical_key(a, b) for a in (None, "", CODE) for b in (None, "", "x")]
    assert len(set(keys)) == 9
    canonical.canonical_key("(((" * 100_000 + "," * 100_000, "\ud800")


@pytest.mark.parametrize("hot_rows", [canonical.HOT_ROWS, 5])
def test_collapse_equals_brute_force(spark, hot_rows):
    random.seed(5)
    pool = [(CODE, "v_1"), *((x, "V 1") for x in SAME), *((x, "v1") for x in OTHER), (None, "v1"), ("", None), (None, None)]
    rows = [(i, *random.choice(pool[:4] if i % 3 == 0 else pool)) for i in range(400)] + [(7, CODE, "v1"), (7, CODE, "v1")]
    df = spark.createDataFrame(rows, "proposal_id long, code_str string, variant_name string").repartition(4).withColumn("key", F.lit("clash"))
    groups, members = canonical.collapse(df, "proposal_id", "code_str", "variant_name", 0.01, hot_rows)
    by = defaultdict(list)
    for i, c, n in rows:
        by[canonical.canonical_key(c, n)].append(i)
    assert sorted((r.representative, r.copies) for r in groups.collect()) == sorted((min(x), len(x)) for x in by.values())
    want = Counter((min(x), i) for x in by.values() for i in x if i != min(x))
    assert Counter((r.representative, r.id) for r in members.collect()) == want
    empty = canonical.collapse(df.limit(0), "proposal_id", "code_str", "variant_name")
    assert empty[0].count() == 0 and empty[1].count() == 0


# -- tokens

TEXTS = ["Hello world", "", None, "  two  blanks\n\n\tand it's 12345 + x²!", "naïve 🙂🙂 数据 تجربة ​\xa0 end ", "a" * 200_000, "Hello world", "<|endoftext|> is text", "\U00012fb1 new lettersࡰ", " ", "\r\n"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("limit", [tokens.HOT_BYTES, 400, 0])
def test_ids_equal_the_tokenizers_and_round_trip(spark, tokenizer, limit):
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("ids", F.lit(2))
    encoded = tokens.encode_documents(df, "doc_id", "text", hot_bytes=limit)
    got = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == Counter((i % 9, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    back = Counter((r.doc_id, r.text) for r in tokens.decode_documents(encoded, "doc_id").collect())
    assert back == Counter((i % 9, t or "") for i, t in enumerate(TEXTS))
    sizes = Counter((r.doc_id, r.size) for r in tokens.token_counts(df, "doc_id", "text", hot_bytes=limit).collect())
    assert sizes == Counter((i, len(ids)) for (i, ids), n in got.items() for _ in range(n))
    assert tokens.encode_documents(df.limit(0), "doc_id", "text").count() == 0
    lost = spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>")
    assert tokens.decode_documents(lost, "doc_id").first().text is None


# -- containers


def simulated(capacity, sizes):
    """Items by the plan, one by one."""
    slots, made = packing.plan(capacity, dict(Counter(sizes)))
    used = Counter()
    by = defaultdict(list)
    for s, start, first, each in sorted(slots):
        by[s].append((start, first, each))
    for s, n in Counter(sizes).items():
        for rank in range(n):
            start, first, each = max(x for x in by[s] if x[0] <= rank)
            used[first + (rank - start) // each] += s
    return used, made


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_without_overflow(seed):
    random.seed(seed)
    capacity = random.choice([10, 97, 512])
    sizes = [random.randint(1, capacity) if random.random() < 0.3 else random.randint(1, max(1, capacity // 4)) for _ in range(random.choice([1, 50, 3000]))]
    used, made = simulated(capacity, sizes)
    assert max(used.values()) <= capacity and len(used) == made and sum(used.values()) == sum(sizes)
    large = sum(2 * s > capacity for s in sizes)
    assert made <= max(large, -(-sum(sizes) // capacity)) * 1.25 + 1


def test_large_items_pair_at_most_twice():
    used, made = simulated(100, [60, 60, 40, 40, 40, 34, 34, 34])
    assert made == 4 and max(used.values()) <= 100  # 60+40 60+40 40+34 34+34
    assert packing.plan(10, {}) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan(10, {11: 1})


def test_packing_places_every_item(spark):
    random.seed(1)
    rows = [(i % 290, random.choice([0, None, 7, 7, 7, 30, 60, 250, 1000])) for i in range(300)]
    items = spark.createDataFrame(rows, "doc_id long, size long").repartition(3).withColumn("piece", F.lit("clash")).withColumn("capacity", F.lit(1))
    packs = spark.createDataFrame([(1, 100, "x"), (2, 999, "y")], "pack_id long, capacity long, pack_name string")
    got = packing.pack(items, packs).collect()
    for p, capacity in ((1, 100), (2, 999)):
        mine = [r for r in got if r.pack_id == p]
        assert sum(r.n_tokens for r in mine) == sum(s or 0 for _, s in rows)
        used = Counter()
        for r in mine:
            used[r.container_id] += r.n_tokens
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        assert Counter(r.doc_id for r in mine if r.piece == 0).total() == 300
        assert sum(used.values()) >= 0.9 * capacity * (len(used) - 1)
    assert packing.pack(items.limit(0), packs).count() == 0 and packing.pack(items, packs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, packs.withColumn("capacity", F.lit(0).cast("long")))


# -- sentences

#: Sentences in the patterns of the corpus, joined at random, so that the boundaries are known. They are not
#: independent of the training texts (the patterns occur there), and rules were mended after this test failed.
KNOWN = {
    "en": ["In Fig. 12, the ledger lost 3.5 % of its value.", "According to Dr. Velmark, no edge was left.", "It fell 3.5 pts. in a week!", "The log line reads \"feed stale.\"", "\"Costs doubled!\" the desk wrote at once.", "Did J. R. Osk check lab/gate_12.py?", "We paid fees, spreads, etc.", "The answer was no... and then it was yes.", "(A rerun is due.)"],
    "de": ["Das Protokoll vom 4. Mai endet um 16.15 Uhr.", "Dr. Velmark prüfte Nr. 547 bzw. Nr. 36 erneut.", "Der Bericht sagt: „Kein Vorteil.“", "„Warum so teuer?“, fragte der Prüfer.", "Wir messen z. B. das Verhältnis."],
    "zh": ["结果……并不理想。", "“没有优势。”日志这样写道。", "为什么跳过第282根K线？", "立即停止！"],
    "hi": ["डॉ. वेलमार्क ने बार 556 फिर से देखा।", "बार 186 क्यों छूट गया?"],
    "ar": ["قال د. فلمارك إن الشريط 691 متأخر.", "سأل المراجع: «من وافق على هذا؟» ثم مضى.", "توقف الآن!"],
}


@pytest.fixture(scope="module")
def model(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    stats = sentences.corpus_stats(documents, "text")
    return sentences.Model(stats, sentences.train(documents, "doc_id", "text", stats))


def test_accuracy_on_joined_sentences(model):
    random.seed(7)
    right = said = known = 0
    for k in range(400):
        lang = random.choice(sorted(KNOWN))
        parts = random.choices(KNOWN[lang], k=random.randint(1, 8))
        text, want = "", set()
        for p in parts:
            text += "" if not text else "" if lang == "zh" else random.choice([" ", " ", "\n", "\n\n", "  "])
            want.add((len(text), len(text) + len(p)))
            text += p
        got = set(sentences.sentences(text, model))
        right, said, known = right + len(got & want), said + len(got), known + len(want)
    assert right / said > 0.95 and right / known > 0.95


def test_sentences_of_layouts(model):
    def parts(text):
        return [text[a:b] for a, b in sentences.sentences(text, model)]

    assert parts("Open questions\n\nFirst line\ngoes on. Second one\r\n\r\n- item one. still\n- item two\n\n1. retry\n2. stop") == ["Open questions", "First line\ngoes on.", "Second one", "- item one. still", "- item two", "1. retry", "2. stop"]
    assert parts("สัญญาณยังไม่ชัดเจนพอ ราคาปิดอยู่ที่ 3.28 ดอลลาร์ของ PEX หยุดทันที") == ["สัญญาณยังไม่ชัดเจนพอ", "ราคาปิดอยู่ที่ 3.28 ดอลลาร์ของ PEX หยุดทันที"]
    assert parts("  🙂 ") == ["🙂"] and parts(" \n\t") == [] and parts("OK") == ["OK"] and parts("x​y") == ["x​y"]


def test_units_of_defined_cases(spark):
    long = "The ledger showed no edge. " * 20_000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One. Two."), (4, "One. Two."), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start_char", F.lit("clash"))
    got = Counter(r.doc_id for r in sentences.sentence_units(df, "doc_id", "text").collect())
    assert got == {4: 4, 5: 20_000}
    assert sentences.sentence_units(df.limit(0), "doc_id", "text").count() == 0
