"""The command line over whole runs, with engines and models of its own."""

import json

import pytest

from quirelake.__main__ import main


def model(told, text, name):
    return f"{told}: {len(text)}"


def broken(content):
    raise RuntimeError("broken")


def plain(content):
    return content.decode()


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = "# T\n" + "many words here. " * 30
    (tmp_path / "in/One Book.pdf").write_text(body)
    (tmp_path / "in/two.pdf").write_text("short")
    out = f"file://{tmp_path}/out"
    done = main(["documents", f"file://{tmp_path}/in", out, "--engine", "bad=tests.test_commands:broken", "--engine", "good=tests.test_commands:plain", "--model", "tests.test_commands:model", "--instructions", "sum"], spark)
    assert {r.status: r.files for r in done.collect()} == {"done": 1, "unusable": 1}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one-book.md", "one-book.transcription.md"]
    assert (tmp_path / "out/one-book.md").read_text().endswith(f"\nsum: {len(body.strip()) + 1}\n")


def test_a_playlist_goes_on_where_it_was(spark, tmp_path):
    rows = [{"url": f"u{i}", "title": f"T{i}", "slug": f"t{i}", "subtitles": None if i == 1 else f"WEBVTT\n\nsaid {i}"} for i in range(3)]
    (tmp_path / "rows.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    command = ["videos", f"file://{tmp_path}/rows.json", f"file://{tmp_path}/out", "--playlist", "Été", "--model", "tests.test_commands:model"]
    first = main(command, spark).first()
    assert (first.done, first.failed) == (2, 1)
    notes = tmp_path / "out/output/videos"
    assert sorted(p.name for p in notes.iterdir()) == ["t0.md", "t2.md"]
    (notes / "t0.md").write_text("edited")
    rows[1]["subtitles"] = "WEBVTT\n\nfound"
    (tmp_path / "rows.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    second = main(command, spark).first()
    assert (second.done, second.failed) == (3, 0) and (notes / "t0.md").read_text() == "edited" and (notes / "t1.md").exists()
    saved = json.loads((tmp_path / "out/jobs/playlist-ete_manifest.json").read_text())
    assert [(v["url"], v["status"]) for v in saved["videos"]] == [(f"u{i}", "done") for i in range(3)]


def test_usage(spark, tmp_path):
    (tmp_path / "log").write_text('{"model":"m","status":"success","input_tokens":3,"estimated_cost_usd":0.5}\n\n{"status":"failed"}\n')
    row = main(["usage", f"file://{tmp_path}/log", "--budget", "2"], spark).first()
    assert (row.request_count, row.failed_requests, row.input_tokens, row.budget_remaining_usd) == (2, 1, 3, 1.5)
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
