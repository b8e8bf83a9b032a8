import json
from urllib.parse import parse_qsl

import pytest

from tidemark.sources.signed import RefusedRequest, SignedReader


def reader(answers, now=(1000.0,)):
    sent, times = [], list(now)

    def fetch(path, headers):
        sent.append((path, headers))
        return answers.pop(0)

    clock = lambda: times.pop(0) if len(times) > 1 else times[0]
    return SignedReader(fetch, lambda text: f"={len(text)}+", "k", "X-Key", "/time", 6000, clock), sent


def test_the_query_is_signed_as_sent():
    r, sent = reader([(200, "[]")])
    assert r.get("/orders", symbol="BTCUSDT", limit=None, closed=False) == "[]"
    path, headers = sent[0]
    query, _, signature = path.removeprefix("/orders?").rpartition("&signature=")
    assert query == "symbol=BTCUSDT&closed=false&recvWindow=6000&timestamp=1000000" and headers == {"X-Key": "k"}
    assert dict(parse_qsl(path.partition("?")[2]))["signature"] == f"={len(query)}+" and "+" not in signature


def test_a_clock_that_is_off_is_set_once():
    off = (400, json.dumps({"code": -1021}))
    r, sent = reader([off, (200, json.dumps({"serverTime": 1005000})), (200, "{}")])
    assert r.get("/a") == "{}" and [p.partition("?")[0] for p, _ in sent] == ["/a", "/time", "/a"]
    assert "timestamp=1005000" in sent[2][0] and sent[1][1] == {}
    r, sent = reader([off, (200, json.dumps({"serverTime": 1005000})), off])
    with pytest.raises(RefusedRequest) as e:
        r.get("/a")
    assert e.value.code == -1021 and len(sent) == 3


@pytest.mark.parametrize("answer", [(401, "{}"), (500, "no json"), (400, json.dumps({"code": -2015}))])
def test_other_refusals_are_not_tried_again(answer):
    r, sent = reader([answer])
    with pytest.raises(RefusedRequest):
        r.get("/a")
    assert len(sent) == 1


@pytest.mark.parametrize("answer", [(500, "{}"), (200, "{}"), (200, "x"), (200, json.dumps({"serverTime": "x"}))])
def test_a_service_without_a_time(answer):
    r, _ = reader([(400, json.dumps({"code": -1021})), answer])
    with pytest.raises(ValueError):
        r.get("/a")
