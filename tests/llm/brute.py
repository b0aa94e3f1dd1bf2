"""Plain versions of the operators' rules, for small tables."""

import re

CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|konto|compte|cuenta",
    "secret": "token|secret|password|api.?key|bearer",
}
PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<!\w)[0-9A-Fa-f]{32,64}(?!\w)",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "iban":
        plain = hit.replace(" ", "")
        turned = plain[4:] + plain[:4]
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
    return True


def pii_spans(text):
    """(start, order, end, kind), of all kinds, in order."""
    spans = []
    for order, (kind, pattern) in enumerate(PATTERN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            around = text[max(0, m.start() - 256) : m.start()], text[m.end() : m.end() + 256]
            context = any(re.search(CONTEXT[kind], x.lower()) for x in around)
            if _valid(kind, m[0]) and (kind != "secret" or context):
                spans.append((m.start(), order, m.end(), kind))
    return sorted(spans)
