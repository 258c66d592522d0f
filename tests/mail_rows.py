"""Helpers that several tests share."""


def ids(frame):
    return [row["message_id"] for row in frame.select("message_id").collect()]
