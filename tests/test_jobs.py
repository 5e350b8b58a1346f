"""An ingest broken off at each point ends with the same rows, once each."""

import os

import pytest

from lodestone.sources import jobs


def shown(job):
    return sorted((r["path"].rpartition("/")[2], r["body"]) for r in job.rows().collect())


def test_broken_ingest_is_taken_up_again(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    for k in range(5):
        (src / ("sub" if k % 2 else "") / f"f{k}.txt").write_text(f"text {k}")
    want = [(f"f{k}.txt", f"text {k}") for k in range(5)]
    job = jobs.Job(spark, f"file://{tmp_path}/out", batch=2)

    def broken(self, number, done):
        raise RuntimeError("lost")

    assert job.run(f"file://{src}", most=1) == 2
    with monkeypatch.context() as m:  # rows are written, their manifest isn't
        m.setattr(jobs.Job, "commit", broken)
        with pytest.raises(RuntimeError):
            job.run(f"file://{src}")
    assert len(shown(job)) == 2 and job.pending(f"file://{src}").count() == 3

    again = jobs.Job(spark, f"file://{tmp_path}/out", batch=2)
    assert again.run(f"file://{src}") == 3 and shown(again) == want
    assert again.run(f"file://{src}") == 0 and shown(again) == want

    (src / "f0.txt").write_text("another 0")  # a changed file, one touched alone, a new one, a lost one
    os.utime(src / "f2.txt", (1, 1))
    (src / "f9.txt").write_text("text 9")
    (src / "sub/f1.txt").unlink()
    assert again.run(f"file://{src}") == 3
    assert shown(again) == [("f0.txt", "another 0"), *want[1:], ("f9.txt", "text 9")]
    assert [r["path"].rpartition("/")[2] for r in again.gone(f"file://{src}").collect()] == ["f1.txt"]


def test_nothing_to_ingest(spark, tmp_path):
    (tmp_path / "src").mkdir()
    job = jobs.Job(spark, f"file://{tmp_path}/out")
    assert job.run(f"file://{tmp_path}/src") == 0 and job.manifest().count() == 0
