import io
import json
import math
import struct
import sys
import tarfile
import wave
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenar.functions import naming, text, urls
from lumenar.operators import clips, html, ledger, notes, transcript
from lumenar.sources import connectors, readers, sinks
from lumenar.streaming import grid


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("o"))
    return [r.o for r in rows.orderBy("i").collect()]


def test_addresses(spark):
    assert column(spark, ["https://www.facebook.com/share/v/12345/?mibextid=abc&__tn__=R", "https://www.facebook.com/watch/?v=6789", "https://x.org/a?v=%zz", "https://x.org/a?v=a%20b&v=c", "no url", None, "https://x.org/#/v/9"], urls.facebook_watch) == [
        "https://www.facebook.com/watch/?v=12345", "https://www.facebook.com/watch/?v=6789", "https://www.facebook.com/watch/?v=%zz", "https://www.facebook.com/watch/?v=a b", "no url", None, "https://x.org/#/v/9"]
    assert column(spark, ["https://x.org/a?v=1"], lambda c: urls.facebook_watch(c, strict=True)) == ["https://x.org/a?v=1"]
    assert column(spark, ["https://www.instagram.com/reel/Ab_1/?x=1", "https://www.tiktok.com/@u/video/1", "https://i.org/p/", None], urls.instagram_post) == ["https://www.instagram.com/reel/Ab_1/", "https://www.tiktok.com/@u/video/1", "https://i.org/p/", None]
    assert column(spark, ["https://m.Facebook.com/x", "http://instagram.com", "https://tiktok.com", "https://youtu.be/1", "https://drive.google.com/x", "https://example.com/facebook", "plain", None, "https://maps.google.de/", "https://facebook.org", "https://x.googleusercontent.com"], urls.host_class) == [
        "facebook", "instagram", "instagram", "youtube", "google_drive", "unknown", "unknown", None, "unknown", "unknown", "google_drive"]
    assert column(spark, ["https://drive.google.com/file/d/0123456789ab/view", "https://d.org/?id=abc", None], urls.drive_file_id) == ["0123456789ab", None, None]
    assert column(spark, ["https://www.münchen.de/a", "http://a.b//c.d/e", "plain", ""], urls.slug) == ["münchen-de", "c-d", "plain", ""]
    assert column(spark, ["https://u:p@Host.org:80/a b?c"], urls.authority) == ["u:p@host.org:80"]


def test_a_hot_name_is_numbered_by_many_tasks(spark):
    rows = spark.range(3000).selectExpr("id as i", "if(id % 3 = 0, 'hot.mp4', if(id % 500 = 1, 'hot_2.mp4', concat('n', id, '.mp4'))) as n").repartition(7)
    found = {r.i: r.unique_name for r in naming.unique_names(rows, "n", ["i"]).collect()}
    hot = [found[i] for i in range(0, 3000, 3)]
    assert hot == ["hot.mp4", *[f"hot_{k}.mp4" for k in range(1, 1001) if k != 2]] and len(set(found.values())) == 3000


def test_texts(spark):
    assert column(spark, [" \xa0a ", None, "\x1cb"], text.strip) == ["a", None, "b"]
    assert column(spark, ["One. Two?  Three!four", " ", None], text.sentences) == [["One.", "Two?", "Three!four"], [], None]
    assert column(spark, ["abc", "abcd", None], lambda c: text.preview(c, 3)) == ["abc", "abc...", None]
    assert column(spark, [2.3, 3661.5, 0.0], lambda c: text.clock(c, ","), "double") == ["00:00:02,299", "01:01:01,500", "00:00:00,000"]
    assert column(spark, [2.675, 0.125, 1.005, None], text.round_half_even, "double") == [round(2.675, 2), 0.12, round(1.005, 2), None]


def test_names(spark):
    assert column(spark, ["90", "1:30", "1:01:05", "x", "1:2:3:4", None, ""], naming.seconds_of) == [90, 90, 3665, None, None, None, None]
    with pytest.raises(Exception, match="not a time"):
        column(spark, ["x"], lambda c: naming.seconds_of(c, strict=True))
    rows = spark.createDataFrame([(1, "x.mp4"), (2, "x.mp4"), (3, "x_1.mp4"), (4, "x.mp4"), (5, "y"), (6, "y"), (7, None)], "i int, n string")
    found = {r.i: r.unique_name for r in naming.unique_names(rows, "n", ["i"]).collect()}
    assert found[1] == "x.mp4" and found[3] == "x_1.mp4" and len({v for v in found.values() if v}) == 6 and found[2] == "x_2.mp4" and found[4] == "x_3.mp4" and found[6] == "y_1"
    taken = spark.createDataFrame([("x.mp4",), ("x_3.mp4",), ("other",)], "n string")
    found = {r.i: r.unique_name for r in naming.unique_names(rows, "n", ["i"], existing=taken).collect()}
    assert set(found) == set(range(1, 8)) and found[3] == "x_1.mp4" and {found[1], found[2], found[4]} == {"x_2.mp4", "x_4.mp4", "x_5.mp4"} and found[5] == "y"
    df = spark.createDataFrame([('{"uploader": null, "uploader_id": "b", "title": "a b", "width": 3}',), ('{"uploader_id": "b"}',), ("[1]",), ("bad",), (None,)], "j string")
    got = naming.masked_metadata(df, "j").collect()
    assert [(r.uploader, r.video_title, r.width) for r in got] == [(None, "a_b", "3"), ("b", None, None), (None, None, None), (None, None, None), (None, None, None)]
    assert column(spark, [".webm", ".MP4", None], lambda c: F.col("v")) and [r.video_codec for r in naming.with_codecs(spark.createDataFrame([(".webm",), (".MP4",), (None,)], "e string"), "e").collect()] == ["libvpx", "libx264", "libx264"]
    assert naming.overlay({"a": 1, "b": 2, "mac": {"b": 3}}, "mac") == {"a": 1, "b": 3, "mac": {"b": 3}} and naming.overlay({"a": 1}, "x") == {"a": 1}
    name = lambda u, d, e: spark.range(1).select(naming.original_filename(F.lit(u).cast("string"), F.lit(d).cast("string"), F.lit(e).cast("string")).alias("o")).first().o
    assert name(" A b/c ", "2024", None) == "A_b_c_2024.mp4" and name(None, " ", "mkv") == "unknown_uploader_unknown_date.mkv"


def test_ledger(spark):
    body = json.dumps({"perform_download": "a.mp4", "z": False, "apply_watermark": True, "odd": 3, "none": None, "text": "true"})
    df = spark.createDataFrame([(1, body), (2, "[]"), (3, None), (4, "{}")], "i int, j string").select("i", ledger.ledger_of(F.col("j")).alias("l"))
    rows = ledger.entries(df, "l").orderBy("i", "pos").collect()
    assert [(r.task, r.state, r.output) for r in rows] == [("perform_download", "DONE", "a.mp4"), ("z", "DISABLED", None), ("apply_watermark", "PENDING", None), ("odd", "SKIPPED", None), ("none", "SKIPPED", None), ("text", "DONE", "true")]
    assert [r.n for r in df.orderBy("i").select(ledger.next_task(F.col("l")).alias("n")).collect()] == ["apply_watermark", None, None, None]
    put = df.withColumn("l", ledger.with_output(F.col("l"), "z", F.lit("o"))).withColumn("l", ledger.with_output(F.col("l"), "new", F.lit("n"))).withColumn("l", ledger.with_output(F.col("l"), "z", F.lit("")))
    assert [(r.task, r.output) for r in ledger.entries(put.filter("i = 1"), "l").orderBy("pos").collect()] == [("perform_download", "a.mp4"), ("z", "o"), ("apply_watermark", None), ("odd", None), ("none", None), ("text", "true"), ("new", "n")]
    filled = df.withColumn("l", ledger.with_defaults(F.col("l"), ledger.default_ledger({"z": True, "q": True})))
    assert [(r.i, r.task, r.state) for r in ledger.entries(filled, "l").filter("task in ('z', 'q')").orderBy("i", "pos").collect()] == [(1, "z", "DISABLED"), (1, "q", "PENDING"), (4, "z", "PENDING"), (4, "q", "PENDING")]
    plan = ledger.dispatch_plan(df.withColumns({"u": F.lit("U"), "f": F.lit("F")}), "l", "u", "f").orderBy("i", "pos").collect()
    assert [(r.task, r.input, r.action) for r in plan][:3] == [("perform_download", "U", "DONE"), ("z", "F", "NO_SCRIPT"), ("apply_watermark", "F", "RUN")]
    docs = spark.createDataFrame([("b", "u1", 1), ("a", "u1", 2), ("c", None, 3)], "path string, url string, n int")
    assert [r.n for r in ledger.find_by_url(docs, F.lit("u1")).collect()] == [2] and ledger.find_by_url(docs, F.lit("x")).count() == 0
    assert {r.url for r in ledger.unknown_only(spark.createDataFrame([("u1",), ("u2",), (None,)], "url string"), docs).collect()} == {"u2", None}
    merged = ledger.merge_forward(docs, [("n", lambda: F.when(F.col("n") > 1, F.col("n") * 10)), ("m", lambda: F.col("n") + 1)]).orderBy("path").collect()
    assert [(r.n, r.m, r.errors) for r in merged] == [(20, 21, []), (1, 2, ["n"]), (30, 31, [])]


def test_pages(spark):
    assert column(spark, ["<p>First paragraph.</p><div>ignored</div><p>Second paragraph.</p>", "", None], html.article_text) == ["First paragraph.\n\nSecond paragraph.", "", None]
    assert html.paragraphs("<p>a<p>b</p>c<p>d") == ["ab"] and html.paragraphs("<p> </p><p>x &amp; y</p>") == ["x & y"]
    page = "<nav>n</nav><article><h1>T</h1><p>a <em>b</em></p><script>s</script><footer>f</footer></article><p>z</p>"
    assert html.editorial(page) == ("T\na\nb", "T a *b* b")
    assert html.editorial("<article><em> a <b> b </b></em></article>")[1].startswith("*ab* ")
    assert html.editorial("<div id='main-content'>m</div><div class='x content'>c</div>")[0] == "m" and html.editorial("<div class='x content'>c</div>")[0] == "c"
    assert html.editorial("<p>a</p><aside><p>b</p></aside><p>c</p>")[0] == "a\nc"
    assert column(spark, [page, None], lambda c: html.editorial_text(c)["plain"]) == ["T\na\nb", None]


def test_transcripts(spark):
    grid_rows = transcript.chunk_grid(spark.createDataFrame([(1, 130.9), (2, 0.5), (3, -3.0), (4, None), (5, 60.0)], "i int, d double"), "d").collect()
    assert sorted((r.i, r.chunk_start, r.chunk_end) for r in grid_rows) == [(1, 0, 60), (1, 60, 120), (1, 120, 130), (5, 0, 60)]
    segs = [("m", 0, 0.0, 1.004, " One two. "), ("m", 1, 1.0, 2.0, "Three"), ("m", 2, 2.0, 3.456, "four. Five"), ("m", 3, None, None, None), ("m", 4, 4.0, 5.0, " "), ("n", 0, 61.0, 62.0, "x"), ("m", 1, 1.0, 2.0, "Three")]
    df = spark.createDataFrame(segs, "media_id string, seg_idx int, start_s double, end_s double, text string")
    assert {r.media_id: r.full_text for r in transcript.segment_text(df.distinct()).collect()} == {"m": "One two. Three four. Five", "n": "x"}
    timed = transcript.timed_sentences(df).orderBy("media_id", "sent_idx").collect()
    assert [(r.sentence, r.start_s, r.end_s) for r in timed] == [("One two.", None, 1.0), ("Three four.", 1.0, 3.46), ("Five", 4.0, 5.0), ("x", 61.0, 62.0)]
    assert transcript.align_to_segments(["a"], []) == [("a", None, None)]
    # the first start that is known counts, and the last end even if it isn't
    assert transcript.align_to_segments(["ab cd."], [(None, 1.0, "ab"), (0.5, None, "cd.")]) == [("ab cd.", 0.5, None)]
    srt = {r.media_id: r.subtitles for r in transcript.subtitles(df).collect()}
    assert srt["n"] == "1\n00:01:01,000 --> 00:01:02,000\nx\n\n"
    assert {r.media_id: r.subtitles for r in transcript.subtitles(df, "vtt").collect()}["n"] == "WEBVTT\n\n00:01:01.000 --> 00:01:02.000\nx\n\n"
    minutes = transcript.minute_transcript(df.distinct()).withColumn("chunk_end", F.col("chunk_start") + 60)
    assert {r.media_id: r.transcript for r in transcript.stitched(minutes).collect()}["n"] == "[60-120 sec]\nx\n"
    pairs = transcript.pairwise_similarity(spark.createDataFrame([(1, "tide", "b"), (2, "diet", "b"), (3, "x", "c"), (4, None, "b")], "i int, t string, b string"), "i", "t", "b").collect()
    assert {(r.i_a if "i_a" in r else r.key_a, r.key_b): r.ratio for r in pairs} == {(1, 2): 0.25, (1, 4): None, (2, 4): None}
    assert column(spark, ["", None, "a"], lambda c: transcript.caption_text(c, F.lit(""))) == ["", "", "a"]


def test_clips(spark):
    df = spark.createDataFrame([("m", 5, 1.0, 2.0, "it's: a\\b"), ("m", 3, 0.0, 1.0, None)], "media_id string, k int, start_s double, end_s double, text string")
    plan = clips.ffmpeg_plan(clips.number_clips(df, "media_id", ["k"]).withColumns({"source": F.lit("in/a.webm"), "folder": F.lit("out")})).orderBy("clip_no").collect()
    assert plan[0].argv == ["ffmpeg", "-i", "in/a.webm", "-ss", "0.0", "-to", "1.0", "-c:v", "libvpx", "-c:a", "libvorbis", "-strict", "experimental", "out/clip_1.mp4"]
    assert plan[1].argv[-2] == "drawtext=text='it'\\''s\\: a\\\\b':x=10:y=10:fontsize=24:fontcolor=yellow" and plan[1].output == "out/clip_2.mp4"
    assert column(spark, ["a/b.webm", "c", None], clips.watermark_target) == ["a/b_wm.mp4", "c_wm.mp4", None]


def test_notes(spark):
    hz = column(spark, ["A4", "C#5", "rest", "REST", "Bb3", None], notes.frequency)
    assert hz[0] == pytest.approx(440.0) and hz[1] == pytest.approx(554.365262) and hz[2:4] == [0.0, 0.0] and hz[4:] == [None, None]
    df = spark.createDataFrame([(1, '{"notes":[{"pitch":"A4","duration":"eighth"},{"pitch":"rest"}]}'), (2, "{}"), (3, None)], "s int, j string")
    listed = notes.notes_from_json(df, "j", "s")
    assert [(r.song, r.pos, r.tempo_bpm) for r in listed.orderBy("pos").collect()] == [(1, 0, 120), (1, 1, 120)]
    waves = notes.wave_files(notes.normalised(notes.note_samples(listed, 800)), 800).collect()
    assert len(waves) == 1 and len(waves[0].wav) == 44 + 2 * (200 + 400)
    assert notes.normalised(notes.note_samples(listed.filter("pitch = 'rest'"), 80)).agg(F.max("sample").alias("m")).first().m == 0


def _by_hand(song):
    """WAV of ``(hz, n)`` notes, sample by sample."""
    audio = [int(16383 * math.sin(2 * math.pi * hz * i / notes.RATE)) for hz, n in song for i in range(n)]
    top = max(map(abs, audio)) or 1
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(notes.RATE)
        out.writeframes(struct.pack(f"<{len(audio)}h", *[int(s * 32767 / top) for s in audio]))
    return buffer.getvalue()


def test_notes_at_full_rate(spark):
    from lumenar.plans import media_queries

    assert media_queries._RATE == notes.RATE == 44100
    rows = [("a", 2, "A4", "sixteenth", 120), ("a", 10, "C#7", "eighth", 90), ("a", 1, "rest", "sixteenth", 60), ("a", 3, "G0", "sixteenth", 240), ("b", 0, "B7", "whole", 30), (None, 0, "C4", "half", 400), ("s", 0, "rest", None, None), ("s", 1, "Bb3", "odd", 120)]
    df = spark.createDataFrame(rows, "song string, pos long, pitch string, duration string, tempo_bpm int")
    hz = lambda steps: 440.0 * 2 ** (steps / 12)
    want = {
        "a": _by_hand([(0.0, 11025), (440.0, 5512), (hz(-50), 2756), (hz(28), 14700)]),
        "b": _by_hand([(hz(38), 352800)]), None: _by_hand([(hz(-9), 13230)]), "s": _by_hand([(0.0, 22050), (0.0, 22050)]),
    }
    pieces = notes.wave_pieces(df).orderBy("song", F.asc_nulls_first("pos")).collect()
    got = {song: b"".join(bytes(r.piece) for r in pieces if r.song == song) for song in want}
    assert {s: len(w) for s, w in got.items()} == {s: len(w) for s, w in want.items()} and got == want
    few = df.filter("song = 'a'")
    assert [bytes(r.wav) for r in notes.wave_files(notes.normalised(notes.note_samples(few))).collect()] == [want["a"]]
    rows_of = notes.note_samples(few).groupBy("song", "pos").agg(F.count("*").alias("n"), F.max(F.abs("sample")).alias("peak"))
    assert sorted(map(tuple, notes.note_pieces(few).drop("pcm").collect())) == sorted(map(tuple, rows_of.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"url": "u", "default_tasks": {"z": true, "a": "x"}}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.txt").write_text("{}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.json").write_text('{"k": 1}')
    docs = readers.metadata_documents(spark, str(tmp_path)).select("url", F.map_keys("default_tasks").alias("keys")).collect()
    assert [(r.url, r["keys"]) for r in docs] == [("u", ["z", "a"])]
    assert readers.metadata_documents(spark, str(tmp_path), recursive=True).count() == 2
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name, data in (("hello.txt", b"hello world"), ("../up.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "hello.txt"
        t.addfile(link)
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    members = readers.tar_members(spark, str(tmp_path / "*tar*")).collect()
    assert sorted((r.member, bytes(r.content)) for r in members) == [("../up.txt", b"x"), ("hello.txt", b"hello world")]
    where = str(tmp_path / "t.tar.gz")

    class Stored(connectors.Downloader):
        def call(self, given):
            return where if given == "0123456789ab" else None

    drive = spark.createDataFrame([("https://drive.google.com/file/d/0123456789ab/view",), ("https://drive.google.com/file/d/missing-file-id/view",)], "u string")
    assert readers.fetched_archives(drive, "u", Stored).count() == 2
    (tmp_path / "clips.json").write_text('{"one": [{"start": 1, "end": 2, "text": "t"}], "two": [[3, 4]]}')
    (tmp_path / "clips2.json").write_text("nope")
    loaded = {r.path.rsplit("/", 1)[1]: r.clips for r in readers.clip_files(spark, str(tmp_path / "clips*.json")).collect()}
    assert [tuple(c) for c in loaded["clips.json"]] == [("one", 1.0, 2.0, "t"), ("two", 3.0, 4.0, None)] and loaded["clips2.json"] is None
    (tmp_path / "urls.json").write_text('[{"url": "a", "tasks": {"x": true}}, {"url": "b"}]')
    assert [r.url for r in readers.url_batch(spark, str(tmp_path / "urls.json")).orderBy("pos").collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("v/a.mp4", 1), (None, 2), ("", 3)], "original_filename string, n int")
    side = sinks.sidecar_documents(df).collect()
    assert [(r.config_json, json.loads(r.body)["n"]) for r in side] == [("v/a.json", 1)]
    files = spark.createDataFrame([(str(tmp_path / "x/a.txt"), "é"), (None, "b")], "path string, body string")
    sinks.write_files(files, "path", "body")
    assert (tmp_path / "x/a.txt").read_text(encoding="utf-8") == "é"
    sinks.copy_files(spark.createDataFrame([(str(tmp_path / "x/a.txt"), str(tmp_path / "y/b.txt")), (str(tmp_path / "none"), str(tmp_path / "y/c.txt"))], "s string, t string"), "s", "t", move=True)
    assert (tmp_path / "y/b.txt").exists() and not (tmp_path / "x/a.txt").exists() and not (tmp_path / "y/c.txt").exists()
    listed = spark.createDataFrame([("b", 0, 1.0, None, "t"), ("a", 1, 3.0, 4.0, None), ("a", 0, 1.0, 2.0, "x")], "name string, pos int, start double, end double, text string")
    assert json.loads(sinks.clip_document(listed).first().body) == {"a": [{"start": 1.0, "end": 2.0, "text": "x"}, {"start": 3.0, "end": 4.0}], "b": [{"start": 1.0, "text": "t"}]}
    logger = sinks.initialise_logging(str(tmp_path / "log"), "lumenar-test")
    assert sinks.initialise_logging(str(tmp_path / "log"), "lumenar-test") is logger and len(logger.handlers) == 2
    manifest = sinks.run_manifest(["u"], {"a": 1})
    sinks.write_manifest(manifest, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["urls"] == ["u"]
    assert sinks.transcripts_map(spark.createDataFrame([("b", "2"), ("a", "1")], "p string, t string"), "p", "t").first().transcripts == '{"a":"1","b":"2"}'


def test_connectors(spark):
    class Echo(connectors.Recogniser):
        def call(self, given):
            if given == "bad":
                raise RuntimeError
            return given.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "p string")
    assert [r.t for r in connectors.apply_connector(df, "p", "t", Echo).collect()] == ["A", None, None]
    media = spark.createDataFrame([("bad.mp4", 70.0), ("a.mp4", 130.0)], "path string, d double")
    cache = spark.createDataFrame([("a.mp4", 60, "held")], "path string, chunk_start long, chunk_text string")

    class Minute(connectors.Recogniser):
        def call(self, given):
            return None if given.startswith("bad") else "" if given.endswith("-60") else given

    rows = transcript.recognised_chunks(media, "path", "d", Minute, cache, attempts=1).collect()
    assert sorted((r.path, r.chunk_start, r.chunk_text, r.status) for r in rows) == [
        ("a.mp4", 0, "[Unintelligible]", "UNINTELLIGIBLE"), ("a.mp4", 60, "held", "CACHED"), ("a.mp4", 120, "a.mp4#120-130", "DONE"),
        ("bad.mp4", 0, "[ERROR: No transcript]", "FAILED"), ("bad.mp4", 60, "[ERROR: No transcript]", "FAILED")]
    waits, tries = [], []
    assert connectors.with_retries(lambda g: tries.append(g), "x", 3, waits.append) is None and waits == [1.0, 2.0] and len(tries) == 3
    links = spark.createDataFrame([("https://drive.google.com/file/d/0123456789ab/view",), ("https://x.org",)], "u string")
    assert [r.file_id for r in connectors.drive_archives(links, "u", strict=False).collect()] == ["0123456789ab"]
    with pytest.raises(Exception, match="not a shared-drive file"):
        connectors.drive_archives(links, "u").collect()


@pytest.fixture
def server(tmp_path):
    """A local server: /page.html, /latin.html, /0123456789ab (a tar file); anything else is 404."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as t:
        t.addfile(_member("hello.txt", 11), io.BytesIO(b"hello world"))
    known = {"/page.html": ("text/html; charset=utf-8", "<p>é</p>".encode()), "/latin.html": ("text/html; charset=latin-1", b"<p>\xe9</p>"), "/0123456789ab": ("application/x-tar", packed.getvalue())}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, body = known.get(self.path, ("", b""))
            self.send_response(200 if kind else 404)
            self.send_header("Content-Type", kind or "text/plain")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}"
    running.shutdown()


def _member(name, size):
    member = tarfile.TarInfo(name)
    member.size = size
    return member


def test_pages_and_archives_over_http(spark, tmp_path, server):
    fetch = connectors.PageFetcher(5)
    assert [fetch.call(server + x) for x in ("/page.html", "/latin.html", "/none")] == ["<p>é</p>", "<p>é</p>", None]
    df = spark.createDataFrame([(server + "/page.html",), (server + "/none",), (None,)], "url string")
    assert [r.html for r in readers.fetched_pages(df, "url").collect()] == ["<p>é</p>", None, None]
    folder, address = str(tmp_path / "archives"), server + "/{}"
    with pytest.raises(RuntimeError, match="404"):
        connectors.ArchiveDownloader(folder, address).call("missing-file-id")
    assert list((tmp_path / "archives").iterdir()) == []
    links = spark.createDataFrame([(f"https://drive.google.com/file/d/{i}/view",) for i in ("0123456789ab", "missing-file-id")], "u string")
    make = lambda: connectors.ArchiveDownloader(folder, address)
    assert [(r.member, bytes(r.content)) for r in readers.fetched_archives(links.limit(1), "u", make).collect()] == [("hello.txt", b"hello world")]
    assert readers.fetched_archives(links, "u", make, strict=False).count() == 1
    with pytest.raises(Exception, match="download failed with status 404"):
        readers.fetched_archives(links, "u", make).collect()


def test_external_programs(tmp_path):
    def program(name, body):
        path = tmp_path / name
        path.write_text(f"#!{sys.executable}\nimport sys\n{body}\n")
        path.chmod(0o755)
        return str(path)

    good, bad = program("good", "print('{\"id\": \"' + sys.argv[-1] + '\"}')"), program("bad", "sys.exit(3)")
    (tmp_path / "jar").write_text("")
    shown = program("shown", "import json; print(json.dumps({'argv': sys.argv[1:]}))")
    assert json.loads(connectors.InfoExtractor((good,)).call("u1")) == {"id": "u1"}
    assert json.loads(connectors.InfoExtractor((shown,), str(tmp_path / "jar")).call("u"))["argv"] == ["--cookies", str(tmp_path / "jar"), "u"]
    assert [connectors.InfoExtractor((x,)).call("u") for x in (bad, str(tmp_path / "none"))] == ["{}", "{}"]
    store = program("store", "open(sys.argv[sys.argv.index('-o') + 1], 'w').write(' '.join(sys.argv[3:]))")
    target = str(tmp_path / "m.mp4")
    assert connectors.Downloader((store,)).call(json.dumps({"url": "u", "original_filename": target, "video_download": {"format": "best", "cookie_path": "c"}})) == target
    assert Path(target).read_text() == "-f best --cookies c --no-playlist u"
    wanted = json.dumps({"url": "u", "original_filename": target})
    assert [connectors.Downloader((x,)).call(g) for x, g in ((bad, wanted), (store, "{}"), (store, "no json"), (store, "[]"))] == [None] * 4
    assert connectors.Encoder().call(json.dumps([good, "out.mp4"])) == "out.mp4" and connectors.Encoder().call(json.dumps([bad, "x"])) is None


def test_recognisers(spark):
    class Deaf(connectors.Recogniser):
        def call(self, given):
            if given == "broken":
                raise ValueError
            return None if given == "quiet" else "said"

    df = spark.createDataFrame([("a",), ("broken",), ("quiet",), (None,)], "p string")
    assert [r.t for r in connectors.recognised_text(df, "p", "t", Deaf).collect()] == ["said", "", "", None]
    with pytest.raises(RuntimeError, match="whisper package not available"):
        connectors.LocalRecogniser()


def test_clip_files_are_merged(spark, tmp_path):
    first, second = {"clip_1": [{"start": 1.0, "text": "a"}], "clip_2": [{"start": 2.0, "text": ""}]}, {"clip_2": [{"start": 9.0, "text": "b", "end": 10.0}], "clip_3": []}
    path = str(tmp_path / "deep" / "clips.yaml")
    for body in (first, second):
        sinks.save_clip_files(spark.createDataFrame([(path, json.dumps(body)), (None, "{}"), ("x", None)], "path string, body string"), "path", "body")
    held = next(iter(readers.clip_files(spark, path).collect())).clips if _has_yaml() else json.loads(Path(path).read_text())
    assert held == first | second if not _has_yaml() else len(held) == 2
    listed = clips.clip_lists(spark.createDataFrame([("m", 5.0, None, None), ("m", 1.0, 2.0, "x")], "media string, start_s double, end_s double, text string"), "media", ["start_s"]).first()
    assert json.loads(listed.clips) == {"clip_1": [{"start": 1.0, "text": "x", "end": 2.0}], "clip_2": [{"start": 5.0, "text": ""}]}


def _has_yaml():
    from importlib.util import find_spec

    return find_spec("yaml") is not None


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0, 7), ("2024-01-01 00:00:50", "a", 2.0, 7), ("2024-01-01 00:05:00", "b", 3.0, 7), ("2024-01-01 02:00:00", "b", 4.0, 7)], "ts string, event_type string, value double, user_id long").selectExpr("cast(ts as timestamp_ntz) ts", "event_type", "value", "user_id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    running = grid.event_counts(stream).writeStream.format("memory").queryName("grid").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(60)
    want = sorted((r.n, r.total) for r in grid.event_counts(rows).collect())
    assert sorted((r.n, r.total) for r in spark.table("grid").collect()) == want == [(1, 3.0), (1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in grid.sessions(rows).collect()) == [1, 3]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"url": "u", "default_tasks": {"x": true, "y": "o"}}')
    docs = spark.readStream.option("wholetext", True).text(str(tmp_path / "docs"))
    query = grid.ledger_stream(docs, str(tmp_path / "cp"), str(tmp_path / "out"))
    query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.url, [(t.key, t.value.state, t.value.output) for t in r.tasks]) for r in out] == [("u", [("x", "PENDING", None), ("y", "DONE", "o")])]
