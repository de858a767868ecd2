"""Events of session logs as tests write them."""


def event(kind, payload=None, ts="2025-01-01T00:00:00Z", **more):
    record = {"timestamp": ts, "type": kind, **more}
    if payload is not None:
        record["payload"] = payload
    return record


def msg(subtype, ts="2025-01-01T00:00:00Z", **payload):
    return event("event_msg", {"type": subtype, **payload}, ts)


def item(subtype, ts="2025-01-01T00:00:00Z", **payload):
    return event("response_item", {"type": subtype, **payload}, ts)
