"""The reference's seed data as typed domain frames (goldens by hand).

Rows inserted in one statement tie on created_at in the reference; here
they get distinct timestamps in insertion order, which is what its
earliest/latest lookups intend.
"""

import datetime as dt

from mercato.sources.domain import DOMAIN_SCHEMAS

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def t(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# Emails, roles, slugs, titles, prices and statuses of the seed
# rows (ids are small integers here). Descriptions, bodies, briefs and notes
# are our own test texts.
USERS = [
    (1, "admin@example.com", "x", "Admin User", "admin", t(0)),
    (2, "editor@example.com", "x", "Editor User", "editor", t(1)),
    (3, "customer1@example.com", "x", "Customer One", "customer", t(2)),
    (4, "customer2@example.com", "x", "Customer Two", "customer", t(3)),
]
PRODUCTS = [
    (11, "brand-style-guide", "Brand Style Guide Template", "a: template document", 4900, True,
     "BRND-001", ["branding", "template"], None, "https://example.com/downloads/brand-style-guide.pdf", t(4), t(4)),
    (12, "website-copy-pack", "Website Copy Pack", "b: page texts", 3900, True,
     "COPY-001", ["copywriting", "landing-page"], None, None, t(5), t(5)),
    (13, "social-ads-kit", "Social Ads Kit", "c: advert pictures", 2900, True,
     "SOC-AD-001", ["ads", "social"], None, None, t(6), t(6)),
    (14, "email-sequence", "Email Sequence Blueprint", "d: mail texts", 3500, True,
     "EMAIL-001", ["email", "automation"], None, None, t(7), t(7)),
    (15, "pitch-deck-design", "Pitch Deck Design Pack", "e: slides", 5900, True,
     "PITCH-001", ["presentation", "startup"], None, None, t(8), t(8)),
    (16, "founder-finance-sheet", "Founder Finance Sheet", "f: budget table",
     4500, True, "FIN-001", ["finance", "spreadsheet"], None, None, t(9), t(9)),
]
SERVICES = [
    (21, "launch-strategy", "Launch Strategy Intensive", "g: planning days",
     15000, True, ["strategy", "launch"], t(10), t(10)),
    (22, "conversion-copy", "Conversion Copywriting Service", "h: writing work",
     18000, True, ["copywriting", "conversion"], t(11), t(11)),
    (23, "brand-refresh", "Brand Refresh Package", "i: drawing work", 24000, True,
     ["branding", "design"], t(12), t(12)),
    (24, "coaching-1-1", "1:1 Founder Coaching", "j: weekly calls", 12000,
     True, ["coaching", "mentorship"], t(13), t(13)),
]
REQUESTS = [
    (31, 3, 22, "quoted", '{"wish": "first test brief", "size": 2}', t(14), t(14)),
    (32, 4, 23, "in_progress", '{"wish": "second test brief", "size": 1}', t(15), t(15)),
]
MESSAGES = [
    (41, 31, 1, "staff writes first", [], t(16)),
    (42, 31, 3, "customer answers", [], t(17)),
    (43, 32, 2, "staff writes about the other request", [], t(18)),
]
QUOTES = [(51, 31, 21000, "test quote notes", "sent", t(19))]
NOTIFICATIONS = [(61, 3, "quote", "test notification", "test notification body",
                  '{"quoteId":51}', None, t(20))]
ORDERS = [(71, 3, "paid", 4900, "digital", t(21), None)]
ORDER_ITEMS = [("81", 71, 11, None, "Brand Style Guide Template", 4900, 1, 4900)]


def seed_tables(spark):
    rows = {"users": USERS, "products": PRODUCTS, "services": SERVICES, "service_requests": REQUESTS,
            "messages": MESSAGES, "quotes": QUOTES, "notifications": NOTIFICATIONS, "orders": ORDERS,
            "order_items": ORDER_ITEMS, "deliverables": [], "coaching_slots": [], "audit_log": []}
    return {name: spark.createDataFrame(r, DOMAIN_SCHEMAS[name]) for name, r in rows.items()}
