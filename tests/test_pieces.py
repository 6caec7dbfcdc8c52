"""Arrow steps hold a bounded number of rows, however many Spark sends at once."""

import tracemalloc

import pyarrow as pa

from segmenta.functions import fragments, migrate
from segmenta.operators import preflight, terms
from segmenta.plans import registry
from segmenta.sources import batches, epub, scans, texts, xhtml


class Frame:
    """Stands for a DataFrame: hands one large Arrow batch to the step and keeps what leaves it."""

    def __init__(self, table):
        self.table, self.schema = table, None

    def select(self, *names):
        return Frame(self.table.select(names))

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter(self.table.combine_chunks().to_batches())))


LONG = "a b. " * 400
MANY = {"doc_id": list(range(3000)), "record_pos": [0] * 3000, "record_id": ["x"] * 3000, "source": [LONG] * 3000, "target": [LONG + "c"] * 3000, "text": [LONG] * 3000}


def test_pieces_keep_rows_and_order():
    for sizes in ([], [0], [1], [5, 0, 7], [1000]):
        given = [pa.record_batch({"x": [f"{n}-{i}" * (i % 13 * 9) for i in range(n)]}) for n in sizes]
        cut = list(batches.pieces(given, 200))
        assert [x for b in cut for x in b["x"].to_pylist()] == [x for b in given for x in b["x"].to_pylist()]
        assert all(b.num_rows <= 1 or b.nbytes <= 200 for b in cut)


def test_steps_let_go_of_rows():
    frame = Frame(pa.table(MANY))
    made = texts.explode_texts(frame, {"doc_id": "long"}, ["text"], {"s": "string"}, lambda t: [(s,) for s in t.split(". ")])
    assert sum(b.num_rows for b in made) == 3000 * 401
    assert max(b.num_rows for b in made) <= (batches.PIECE // len(LONG) + 1) * 401
    moved = migrate.migrations(Frame(pa.table(MANY | {"source": ["<b>x</b> " + LONG] * 3000})), {"doc_id": "long"})
    assert sum(b.num_rows for b in moved) == 3000 and max(b.num_rows for b in moved) < 300
    assert max(b.num_rows for b in epub._rows(frame, ["doc_id", "text"], "book long, text string", lambda b, t: [(b, t)])) == 1


def test_step_modules_read_pieces():
    assert all(m.pieces is batches.pieces for m in (texts, terms, epub, fragments, migrate))


def test_spans_are_blamed_without_further_steps(spark):
    """A span's records meet once, in one step in Python, and their blame needs no join."""
    rows = [(1, 0, 0, "a", "<b>x</b> –", "<i>x</i>"), (1, 1, 1, "b", "y", None), (1, 2, 5, "c", "– z", "z"), (2, 0, 0, "a", "<b>", "<b>"), (2, 1, 1, "b", "u", "v")]
    records = spark.createDataFrame(rows, "doc_id long, record_pos long, span_index long, record_id string, source string, target string")
    found = preflight.findings(spark.createDataFrame([(1, 0), (1, 4), (2, 0)], "doc_id long, span_index long"), records)
    got = {(r["doc_id"], r["start"], r["rule"], r["record_id"], r["record_ids"]) for r in found.collect()}
    assert got == {
        (1, 0, "inline_xhtml_preserved", "a", "a,b"), (1, 0, "inline_xhtml_no_new_attributes", "a", "a,b"), (1, 0, "dash_semantic_cue_missing", "a", "a,b"), (1, 0, "missing_translation", "b", "b"),
        (1, 4, "dash_semantic_cue_missing", "c", "c"), (2, 0, "inline_xhtml_parseable", "a", "a,b"),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1


def test_stores_are_read_and_parsed_once(spark):
    files = spark.createDataFrame([(1, "{}"), (2, '{"version": 2, "records": []}'), (3, '{"version": 2, "records": {}}'), (4, '{"version": 1, "records": {}} x')], "doc_id long, content string")
    found = scans.store_findings(files, ["doc_id"])
    assert {r["doc_id"]: r["detail"] for r in found.collect()} == {1: "field records", 2: "field records", 4: "json"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("try_parse_json") + plan.count("parse_json(") <= 4


def test_a_block_is_read_without_a_tuple_for_each_character():
    page = f"<p>{'wolf and den ' * 40_000}</p>"
    tracemalloc.start()
    ((_, block, *_), _), (_, most) = xhtml.rows(page), tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert block == page[3:-5] and most < 20 * len(page)


def test_forms_of_plain_and_odd_characters_stand_in_order():
    page = "<p>a  b c\n&gt; > &gt; & &amp;  ]-^ é&eacute;é</p>"
    (block, _, tokens, tags, forms), _ = xhtml.with_forms(page)
    assert block == "a b c > > > & & ]-^ ééé" and xhtml.refill(block, tokens, tags, forms) == page[3:-4]
    assert forms == {" ": ["  ", " ", "\n", " ", " ", " ", " ", "  ", " "], ">": ["&gt;", ">", "&gt;"], "&": ["&", "&amp;"], "é": ["é", "&eacute;", "é"]}
    assert xhtml.refill("> > > > <", tokens, tags, forms) == "&gt;  > &gt;\n&gt; &lt;"


def test_books_are_zipped_and_unzipped_once(spark):
    plan = registry.queries()["epub_rebuild"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # spans of the documents as they were, and the package of those translated
    assert plan.count("MapInArrow") == 2
