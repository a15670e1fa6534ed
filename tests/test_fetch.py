"""Pages and posts by data sources with an injected transport."""

import os

from tessera.sources import boards, fetch


class Site:
    """Pages in a folder; a page named flaky fails twice in each process."""

    def __init__(self, folder):
        self.folder, self.seen = str(folder), {}

    def __call__(self, url, params):
        name = "-".join([url, *(str(v) for v in params.values())])
        self.seen[name] = self.seen.get(name, 0) + 1
        if os.path.exists(f"{self.folder}/{name}.flaky") and self.seen[name] < 3:
            raise TimeoutError("try again")
        with open(f"{self.folder}/{name}", "rb") as f:
            return f.read()

    def put(self, name, text, flaky=False):
        with open(f"{self.folder}/{name}", "wb") as f:
            f.write(text)
        if flaky:
            open(f"{self.folder}/{name}.flaky", "w").close()


def test_pages_retries_and_errors(spark, tmp_path):
    site = Site(tmp_path)
    for n in range(1, 7):
        site.put(f"list-{n}", f"page {n} ".encode() + b"\xff\xed", flaky=n == 4)
    spark.dataSource.register(fetch.page_source(site, "test_pages", back_off=0, delay=0))
    load = lambda **o: spark.read.format("test_pages").options(url="list", **o).load()
    df = load(last=8)
    assert df.rdd.getNumPartitions() == 8 and load(last=8, each=3).rdd.getNumPartitions() == 3
    rows = {r.page: r for r in df.collect()}
    assert [rows[n].tries for n in range(1, 9)] == [1, 1, 1, 3, 1, 1, 3, 3]
    assert rows[4].html == "page 4 ��" and rows[4].error is None
    assert rows[8].html is None and rows[8].error.startswith("FileNotFoundError")
    assert load(last=0).count() == 0


def test_stored_pages_are_read_by_blocks(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(n, f"page {n}" if n != 11 else None) for n in (*range(3, 9), 10, 11, 40)], "page_id long, html string")
    served = fetch.stored_pages(pages, f"file://{tmp_path}/pages", "page_id", "html", block=4)
    import pyarrow.dataset as ds

    read, opened = [], ds.dataset
    monkeypatch.setattr(ds, "dataset", lambda path, **more: read.append(path[-7:]) or opened(path, **more))
    fetcher = fetch.Fetcher(served, back_off=0, delay=0)
    got = {n: fetcher.get("pages", {"page": n}) for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 30, 40)}
    assert got[3] == ("page 3", 1, None) and got[40] == ("page 40", 1, None)
    assert [n for n, g in got.items() if g[0] is None and g[1] == 3] == [9, 11, 30]
    assert read == ["block=0", "block=1", "block=2", "lock=10"]


def test_back_off_grows(monkeypatch):
    slept = []
    monkeypatch.setattr(fetch.time, "sleep", slept.append)

    def broken(url, params):
        raise OSError("down")

    assert fetch.Fetcher(broken).get("u", {}) == (None, 3, "OSError: down") and slept == [1.5, 3.0]
    slept.clear()
    assert fetch.Fetcher(lambda u, p: b"ok").get("u", {}) == ("ok", 1, None) and slept == [0.3]


def listed(site, posts):
    posts = sorted(posts, reverse=True)
    for page, a in enumerate(range(0, len(posts) + 2, 2), 1):
        rows = "".join(f'<tr><td><a href="#" data-id="{p}" class="nttInfoBtn">post {p}</a></td></tr>' for p in posts[a : a + 2])
        site.put(f"board-{page}", f"<tbody>{rows}</tbody>".encode())


def test_new_posts_as_a_stream_that_restarts(spark, tmp_path):
    site = Site(tmp_path / "site")
    os.makedirs(site.folder)
    spark.dataSource.register(fetch.post_source(site, "test_posts", back_off=0, delay=0))

    def run():
        stream = spark.readStream.format("test_posts").options(url="board", post_url="post", after=3).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        return sorted((r.ntt_sn, r.html, r.error is None) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for p in (2, 5, 9, 12, 13):
        site.put(f"post-{p}", f"text {p}".encode())
    listed(site, [2, 5, 9, 12, 13, 7])
    first = run()
    assert first == [(5, "text 5", True), (7, None, False), (9, "text 9", True), (12, "text 12", True), (13, "text 13", True)]
    assert run() == first  # nothing new
    for p in (20, 21, 40):
        site.put(f"post-{p}", f"text {p}".encode())
    listed(site, [2, 5, 7, 9, 12, 13, 20, 21, 40])
    assert run() == first + [(20, "text 20", True), (21, "text 21", True), (40, "text 40", True)]


def test_the_newest_post_is_the_same_by_column_and_source(spark):
    html = '<a href="#" data-id="77" class="nttInfoBtn"> Newest  <b>post</b></a><a data-id="5" class="nttInfoBtn">x</a>'
    row = spark.createDataFrame([(html,)], "html string").select(boards.latest_post("html").alias("p")).first()
    assert row.p.ntt_sn == "77" and row.p.title == "Newest post"
