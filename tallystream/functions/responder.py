"""Rule responder and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, or_empty

# Replies, and the words that trigger them, in order.
BLANK_REPLY = "پیام خالیه 🤖"
RULES = [("سلام", "سلام 👋 خوش اومدی"), ("چطوری", "من خوبم 😄 تو چطوری؟")]
ECHO = "گرفتم 👌: "
SERVER_ERROR = "خطا در سرور ❌"
HEALTH, PING = "OK", "pong"


def rule_reply(message: Column) -> Column:
    """Blank guard, then the first rule that matches, then an echo of the untrimmed message."""
    m = or_empty(message)
    out = F.when(is_blank(m), F.lit(BLANK_REPLY))
    for word, reply in RULES:
        out = out.when(F.contains(m, F.lit(word)), F.lit(reply))
    return out.otherwise(F.concat(F.lit(ECHO), m))


def route_reply(method: Column, path: Column, message: Column, failed: Column | None = None) -> Column:
    """Text for a request; NULL for an unmatched route. failed marks messages that can't become a string."""
    get, post = method == "GET", method == "POST"
    chat = F.when(failed, F.lit(SERVER_ERROR)).otherwise(rule_reply(message)) if failed is not None else rule_reply(message)
    return F.when(get & (path == "/"), F.lit(HEALTH)).when(get & (path == "/ping"), F.lit(PING)).when(post & (path == "/chat"), chat)


def route_status(method: Column, path: Column, failed: Column | None = None) -> Column:
    """200 for a route, 500 for a failed chat message, 404 for anything else."""
    get, post = method == "GET", method == "POST"
    chat = F.when(failed, F.lit(500)).otherwise(F.lit(200)) if failed is not None else F.lit(200)
    return F.when(get & path.isin("/", "/ping"), F.lit(200)).when(post & (path == "/chat"), chat).otherwise(F.lit(404))
