import json
from hashlib import sha256

from grocerlake.sources import tables as tb


def test_markdown(spark, tmp_path):
    (tmp_path / "sugar.md").write_text('```json\n{"authority": "WHO", "domains": ["sugar", "diet"]}\n```\n\n# Sugar\n\nText.\n')
    (tmp_path / "plain.md").write_text("no heading")
    got = {r.filename: r for r in tb.read_knowledge_markdown(spark, str(tmp_path)).collect()}
    s = got["sugar.md"]
    assert (s.title, s.metadata["authority"], s.domains, s.body) == ("Sugar", "WHO", ["sugar", "diet"], "# Sugar\n\nText.")
    assert (got["plain.md"].title, got["plain.md"].metadata, got["plain.md"].body) == ("plain", {}, "no heading")


def test_cases_and_their_hash(spark, tmp_path):
    lines = [json.dumps({"id": "a", "question": "q?"}), json.dumps({"id": "b", "question": "r?", "expected_sources": ["x.md"]})]
    (tmp_path / "a.jsonl").write_text(lines[0] + "\n\n")
    (tmp_path / "b.jsonl").write_text("  " + lines[1] + "\n")
    cases, digest = tb.read_eval_cases(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert digest.first()[0] == sha256("\n".join(lines).encode()).hexdigest()
    assert {r.id: r.expected_sources for r in cases.collect()} == {"a": None, "b": ["x.md"]}


def test_dump(spark, tmp_path):
    rows = [{"code": "1", "status": 1, "product": {"product_name": "x", "nutriments": {"sugars_100g": 3}}}, {"code": "2", "product_name": "y"}]
    (tmp_path / "d.json").write_text("\n".join([*map(json.dumps, rows), "broken"]))
    got = {r.barcode: r.product.product_name for r in tb.read_product_dump(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"1": "x", "2": "y"}
