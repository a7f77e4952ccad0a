import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import pacing
from shelfmark.sources import demo, markets


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_a_token_is_kept_until_a_minute_before_its_end():
    clock, fetched = Clock(), []
    token = markets.Token(lambda: (fetched.append(1) or f"t{len(fetched)}", 300), clock)
    seen = []
    for now in (0, 100, 239, 240, 241, 479.9, 480):
        clock.now = now
        seen.append(token())
    assert seen == ["t1", "t1", "t1", "t2", "t2", "t2", "t3"]


def test_calls_keep_their_distance():
    clock = Clock()
    pace = markets.Pace(1.2, clock, clock.sleep)
    for more in (0.2, 2.0, 0.0):
        pace()
        clock.now += more
    pace()
    assert clock.slept == pytest.approx([1.0, 1.2])


ROWS = [{"seq": k, "query": f"q{k}"} for k in range(5)]


def lane(kind, statuses, pages=1, limit=2, full=(), denied=None):
    calls, told = [], []

    def call(query, offset, n):
        calls.append((query, offset))
        return statuses.get(query, 200), json.dumps({markets.LISTS[kind]: [{}] * (limit if (query, offset) in full else 1)})

    latch = denied or (lambda x: told.append(x) or False if x else False)
    return list(markets.asked(ROWS, call, kind, limit, pages, latch, lambda: None)), calls, told


def test_a_lane_that_is_refused_sold_items_asks_no_more():
    for status in (401, 403):
        got, calls, told = lane("sold", {"q2": status, "q1": 500})
        assert [r[1] for r in got] == ["q0"] and calls == [("q0", 0), ("q1", 0), ("q2", 0)] and told == [True]
    assert lane("sold", {}, denied=lambda told: True)[1] == []  # another lane was told so


def test_failures_of_active_searches_stop_and_those_of_a_shop_do_not():
    with pytest.raises(RuntimeError, match="429.*too many"):
        lane("active", {"q1": 429})
    with pytest.raises(RuntimeError, match="503"):
        lane("active", {"q3": 503})
    assert [r[1] for r in lane("shop", {"q1": 403, "q2": 0})[0]] == ["q0", "q3", "q4"]


def test_pages_are_read_while_they_are_full():
    got, calls, _ = lane("active", {}, pages=3, full={("q0", 0), ("q0", 2), ("q0", 4), ("q1", 0)})
    assert [c for c in calls if c[0] in ("q0", "q1")] == [("q0", 0), ("q0", 2), ("q0", 4), ("q1", 0), ("q1", 2)]
    assert [r[2] for r in got if r[1] == "q0"] == [0, 2, 4]


def test_a_lane_holds_the_landed_answers_of_one_query():
    taken = []

    def rows():
        for k in range(50):
            for offset in (0, 2) if k % 3 else (None,):
                taken.append(k)
                yield {"seq": k, "query": f"q{k // 2}", "offset": offset, "status": None if offset is None else 200, "body": f"{k}-{offset}"}

    call = markets.Landed(rows())
    for k, row in enumerate(call.queries()):
        assert (row["seq"], row["query"]) == (k, f"q{k // 2}") and max(taken) <= k + 1
        assert [call(row["query"], offset, 2) for offset in (0, 2, 4)] == ([(200, f"{k}-0"), (200, f"{k}-2"), (404, None)] if k % 3 else [(404, None)] * 3)
    assert k == 49


@pytest.fixture
def service():
    seen = {"tokens": 0, "calls": [], "status": 200}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body):
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            seen["tokens"] += 1
            self.answer(200, {"access_token": f"t{seen['tokens']}", "expires_in": 7200} if self.headers["Authorization"].startswith("Basic ") else {})

        def do_GET(self):
            said = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen["calls"].append((self.headers.get("Authorization"), said))
            first = int(said.get("offset", 0))
            n = max(0, min(int(said.get("limit", 50)), 5 - first))
            items = [{"itemId": f"{said.get('q')}-{first + i}", "title": "x", "price": {"value": "3.5"}} for i in range(n)]
            self.answer(seen["status"], {"itemSummaries": items, "itemSales": items, "items": [{"gcode": said.get("s_keywords")}]})

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_over_http(spark, service):
    url, seen = service
    queries = spark.createDataFrame([("a b",), ("c",), (None,)], "query string")
    said = {"url": url, "token_url": f"{url}/token", "client_id": "i", "client_secret": "s"}
    got = markets.answers(queries, "active", lanes=2, limit=3, pages=2, category="348", **said).collect()
    assert sorted((r.seq, r.query, r.page_start, len(json.loads(r.body)["itemSummaries"])) for r in got) == [(1, "a b", 0, 3), (1, "a b", 3, 2), (2, "c", 0, 3), (2, "c", 3, 2)]
    assert 1 <= seen["tokens"] <= 2 and all(auth.startswith("Bearer t") and q["category_ids"] == "348" and q["filter"] == "buyingOptions:{FIXED_PRICE|AUCTION}" for auth, q in seen["calls"])
    seen["status"], seen["calls"] = 403, []
    assert markets.answers(queries, "sold", lanes=1, **said).collect() == [] and len(seen["calls"]) == 1
    seen["status"] = 429
    with pytest.raises(Exception, match="too many calls"):
        markets.answers(queries, "active", **said).collect()
    seen["status"] = 200
    shop = markets.answers(queries.filter("query = 'c'"), "shop", url=url, limit=80).collect()
    assert [json.loads(r.body)["items"] for r in shop] == [[{"gcode": "c"}]] and seen["calls"][-1][1]["pagemax"] == "50"
    assert markets.answers(queries.filter("false"), "active", url=url).count() == 0
    with pytest.raises(ValueError):
        markets.answers(queries, "other")


def stepped(seed):
    """The generator, step by step, on plain integers."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ (state >> 15)) * (1 | state) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield (t ^ (t >> 14)) / 4294967296


def test_draws_and_histories_equal_a_generator_that_steps(spark):
    figures = [(k, seed, 40.0 + 150 * k, 0.1 * k - 0.2, 0.03, 20.0) for k, seed in enumerate([0, 1, 24301 + 7919, 0xFFFFFFFF, 0x80000000])]
    frame = spark.createDataFrame(figures, "figure_id long, seed long, market_usd double, drift double, volatility double, floor_usd double")
    days = 25
    drawn = {r.seed: r.u for r in frame.select("seed", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda n: demo.draw(F.col("seed"), n)).alias("u")).collect()}
    for seed, got in drawn.items():
        rng = stepped(seed)
        assert list(got) == [next(rng) for _ in range(2000)]
    walks = {r.figure_id: list(r.walk) for r in demo.walks(frame, days).collect()}
    sold = sorted((r.figure_id, r.days_ago, r.condition, r.k, r.amount_usd) for r in demo.sales(frame, days).collect())
    asks = sorted((r.figure_id, r.k, r.condition, r.amount_usd) for r in demo.asks(frame, days).collect())
    cents = lambda x: int(x * 100 + 0.5) / 100
    want_sold, want_asks = [], []
    for k, seed, market, drift, volatility, floor in figures:
        rng, values = stepped(seed), [market]
        for i in range(days):
            shock = (next(rng) - 0.5) * 2 * volatility
            if i < days - 1:
                values.append(max(values[-1] / (1 + drift / 365 + shock), floor))
        assert walks[k] == values[::-1]
        for i, base in enumerate(values[::-1]):
            for condition, factor in zip(demo.CONDITIONS, (1, 0.72), strict=True):
                for j in range(int(next(rng) * (2.2 if base > 300 else 4.0))):
                    want_sold.append((k, days - 1 - i, condition, j, cents(base * factor * (1 + (next(rng) - 0.5) * 0.18))))
        for j in range(2 + int(next(rng) * 4)):
            want_asks.append((k, j, demo.CONDITIONS[j % 3 == 0], cents(market * (1.05 + next(rng) * 0.35))))
    assert sold == sorted(want_sold) and asks == sorted(want_asks)
    for made in (demo.sales(frame, days), demo.asks(frame, days)):
        assert "size(" not in made._jdf.queryExecution().optimizedPlan().toString()  # no filter that makes the walk once more
    snaps = demo.snapshots(demo.sales(frame, days)).collect()
    assert sum(r.sample_size for r in snaps) == len(sold) and all(r.min_usd <= r.median_usd <= r.max_usd < r.lowest_ask_usd * 10 for r in snaps)
    assert demo.walks(frame, 1).first().walk == [40.0]


def test_lanes_do_not_overlap_and_hosts_are_left_alone_long_enough(spark):
    rows = [(k, f"h{k % 3 if k % 5 else 0}", float(1 + (k * 7) % 11), [0.5, 2.0, 9.0][k % 3 if k % 5 else 0]) for k in range(200)]
    frame = spark.createDataFrame(rows, "id long, host string, seconds double, interval double").repartition(5)
    for lanes in (1, 4, 7):
        got = sorted(pacing.scheduled(frame, lanes, F.col("id")).collect(), key=lambda r: r.seq)
        assert [r.id for r in got] == list(range(200)) and min(r.starts_at for r in got) == 0
        for of, room in (("lane", lambda r: r.seconds), ("host", lambda r: r.interval)):
            last = {}
            for r in sorted(got, key=lambda r: (r.starts_at, r.seq)):
                assert r.starts_at >= last.get(r[of], 0)
                last[r[of]] = r.starts_at + room(r)
        assert len({r.lane for r in got}) == lanes
    assert pacing.scheduled(frame.filter("false"), 4, F.col("id")).count() == 0


def test_products_are_spread_over_tasks(spark):
    from shelfmark.plans import mechanisms, round_trips

    few = 4 * spark.sparkContext.defaultParallelism
    assert mechanisms.demo_figures(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == few
    assert round_trips.items(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == few


def test_active_listings_go_on_until_a_page_is_not_full(spark, tmp_path):
    from shelfmark.plans import mechanisms

    sizes = {1: 47, 2: 30, 3: 0, 4: 10, 5: 1, 6: 250}
    spark.createDataFrame([(k, 1, f"p{k}") for k in sizes], "p_partkey long, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, i // 7, i % 7, 1.0 + i) for k, n in sizes.items() for i in range(n)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.seq, r.page_start, r.amount) for r in mechanisms.market_active(spark, str(tmp_path)).collect())
    assert got == [(k, i // 10 * 10, 1.0 + i) for k, n in sizes.items() for i in range(n)]


def test_pages_without_a_last_one_are_asked_for_and_held_one_by_one():
    assert [c for c in lane("active", {}, pages=None, full={("q1", 2 * k) for k in range(40)})[1] if c[0] == "q1"] == [("q1", 2 * k) for k in range(41)]
    taken = []

    def rows():
        for offset in range(0, 100, 2):
            taken.append(offset)
            yield {"seq": 1, "query": "q", "offset": offset, "status": 200, "body": str(offset)}

    call = markets.Landed(rows())
    for row in call.queries():
        for offset in range(0, 100, 2):
            assert call(row["query"], offset, 2) == (200, str(offset)) and max(taken) <= offset + 2
        assert call(row["query"], 100, 2) == (404, None)
