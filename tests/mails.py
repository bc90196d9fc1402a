"""Hand-written messages."""

from __future__ import annotations

import datetime as dt
from email.message import EmailMessage

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
MAIL_SCHEMA = "msg_id string, received_at timestamp, content binary"

HEAD = "ФЛС № 123 АДРЕС: ул. Мира, д. 1 ПЕРИОД: 3 месяц 2024 год\n"


def bill(lines: str = "ХВС 5 м3 45,00 225,00\n", head: str = HEAD, tail: str = "Итого к оплате: 225,00") -> str:
    return head + lines + tail


def page(rows: list[tuple[str, ...]], head: str = HEAD, tail: str = "Итого к оплате: 10.00") -> str:
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows)
    return f"<html><body><p>{head}</p><table>{cells}</table><p>{tail}</p></body></html>"


def message(*parts: tuple[str, str], subject: str = "Счёт", sender: str = "a@b.example") -> bytes:
    """Parts are (subtype, text); several make a multipart message."""
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = sender, "me@home.example", subject
    if len(parts) == 1:
        mail.set_content(parts[0][1], subtype=parts[0][0])
    else:
        mail.make_mixed()
        for subtype, text in parts:
            part = EmailMessage()
            part.set_content(text, subtype=subtype)
            mail.attach(part)
    return mail.as_bytes()


def text_mail(text: str) -> bytes:
    return message(("plain", text))


def html_mail(text: str) -> bytes:
    return message(("html", text))


def mail_rows(contents: list[bytes]) -> list[tuple]:
    return [
        (f"m{i:03d}.eml", START + dt.timedelta(minutes=i), content) for i, content in enumerate(contents)
    ]
