"""Column functions over mail addresses and senders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Senders, domains and patterns of mail that no person wrote.
BOT_SENDERS = (
    "mail delivery subsystem", "mailer-daemon", "postmaster", "noreply", "no-reply", "donotreply", "do-not-reply",
    "accounts payable", "relay test", "auto responder",
)
BOT_DOMAINS = (
    "linkedin.com facebookmail.com twitter.com x.com pandadoc.com pandadoc.net docusign.com docusign.net calendly.com "
    "zoom.us slack.com notion.so asana.com trello.com github.com gitlab.com bitbucket.org stripe.com paypal.com square.com "
    "mailchimp.com sendgrid.net hubspot.com intercom.io united.com delta.com aa.com southwest.com uber.com lyft.com "
    "doordash.com grubhub.com amazon.com apple.com google.com netflix.com spotify.com insider.group substack.com medium.com "
    "beehiiv.com"
).split()
BOT_PATTERNS = (
    r"newsletter", r"notifications?@", r"updates?@", r"info@", r"support@", r"billing@", r"receipts?@", r"orders?@",
    r"shipping@", r"team@", r"hello@.*\.(io|com|co|ai)\z", r"auto[-_]?respond", r"^paradigm\s+auto",
    r"accounts?\s+payable", r"relay\s+test", r"pandadoc", r"docusign", r"^zara\s+whitfield",
)


def is_bot(email: Column, name: Column) -> Column:
    e, n = F.lower(F.coalesce(email, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    found = n.isin(*BOT_SENDERS) | local.isin(*BOT_SENDERS) | domain.isin(*BOT_DOMAINS)
    for sender in BOT_SENDERS:
        found |= n.contains(sender)
    pattern = "|".join(f"(?:{p})" for p in BOT_PATTERNS)
    return found | e.rlike(pattern) | n.rlike(pattern)


TRANSACTIONAL = (
    r"(?i)^(appointment|booking|confirmation|receipt|invoice|order|shipping|delivery"
    r"|your .* (order|booking|receipt|confirmation|password|account))"
    r"|^(action required|verify your|reset your|welcome to|invitation:)"
)


def signature_form(line: Column) -> Column:
    """A line without formatting, punctuation and repeated white space, in lower case."""
    plain = F.regexp_replace(F.lower(line), r"[*_~`#>|]", "")
    plain = F.regexp_replace(plain, r"[^\w\s@.-]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
