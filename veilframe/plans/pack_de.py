"""German rules.  Everything in this module is a fixed value: the patterns (in their original dialect, see functions.dialect), their order, and the placeholders."""

# Placeholder of each tag.
PLACEHOLDERS = {
    "PHONE": "[Telefon]",
    "EMAIL": "[E-Mail]",
    "URL": "[URL]",
    "SECRET": "[Geheim]",
    "ACCOUNT": "[Konto]",
    "ADDRESS": "[Adresse]",
    "HANDLE": "[Handle]",
    "REF": "[Referenz]",
    "TITLE": "[Anrede]",
    "NUMBER": "[Zahl]",
    "MONEY": "[Betrag]",
    "COMPANY": "[Firma]",
    "TERM": "[REDACTED]",
    "NAME": "[Name]",
}

# Order in which rules win, first to last.
PRIORITY = [
    "secret", "login", "aktenzeichen_tail", "id_label_tail", "insurance_id2", "ref_generic_tail_de", "tax_id", "vat_id", "svnr", "id_card",
    "passport", "driver_license", "driver_license_bare_short", "driver_license_ocr_label", "birthdate", "birthplace_optional_secret", "birthplace",
    "birthdate_bare", "birthplace_bare", "id_card_bare", "passport_bare", "driver_license_bare", "account_holder_name_keep_title", "account",
    "account_bare_iban", "account_bare_iban_multiline", "bank", "blz_paren", "blz", "creditcard", "email", "url", "money_negative", "money", "phone",
    "person_name_keep_title", "person_name_inline", "person_name", "person_name_broken_ocr", "recipient_name_nextline",
    "recipient_name_nextline_broken_ocr", "titled_name_bare", "titled_name_bare_broken_ocr", "titled_name_bare_multiline", "company_tx_line",
    "company_tx_line_broken_ocr", "company_label", "company", "address_de_inline_street", "address_de_extra_partial", "address_de_street_partial",
    "klingel_name", "handle", "api_key_token", "bearer_token", "security_answer", "ip_label", "ip_address", "mac_label", "mac_address", "imei2",
    "device_fingerprint", "uuid2", "bank_routing_ids", "avs_data", "three_ds_status", "eci", "legal_ref_tail", "wallet_id", "tx_hash",
    "crypto_wallet", "access_token_bare", "session_id_bare", "card_expiry_de", "card_security_de", "number",
]

# Rules that cannot be switched off.
ALWAYS_ON = [
    "secret", "login", "aktenzeichen_tail", "id_label_tail", "ref_generic_tail_de", "tax_id", "vat_id", "svnr", "id_card", "passport",
    "driver_license", "driver_license_bare_short", "driver_license_ocr_label", "birthdate", "birthplace", "birthdate_bare", "birthplace_bare",
    "id_card_bare", "passport_bare", "driver_license_bare", "account", "account_bare_iban", "account_bare_iban_multiline", "bank", "blz",
    "creditcard", "email", "url", "money_negative", "money", "phone", "person_name_keep_title", "person_name_inline", "person_name",
    "person_name_broken_ocr", "recipient_name_nextline", "recipient_name_nextline_broken_ocr", "titled_name_bare", "titled_name_bare_broken_ocr",
    "titled_name_bare_multiline", "company_tx_line", "company_tx_line_broken_ocr", "company_label", "company", "address_de_inline_street",
    "address_de_extra_partial", "address_de_street_partial", "klingel_name", "api_key_token", "bearer_token", "security_answer", "ip_label",
    "ip_address", "mac_label", "mac_address", "imei2", "device_fingerprint", "uuid2", "bank_routing_ids", "avs_data", "three_ds_status", "eci",
    "legal_ref_tail", "wallet_id", "tx_hash", "crypto_wallet", "insurance_id2", "access_token_bare", "session_id_bare",
    "account_holder_name_keep_title", "blz_paren", "card_expiry_de", "card_security_de", "birthplace_optional_secret",
]

# Key, tag, mode, flags, pattern.
RULES = [
    ("login", "HANDLE", "prefix", "giu", r"((?:Benutzername|User(?:name)?|Login-?ID|User-?ID|Account-?ID)[ \t]*[:：=][ \t]*)([^\n\r]{1,80})"),
    ("secret", "SECRET", "prefix", "giu", r"((?:Passwort|Kennwort|PIN|TAN|OTP|2FA|Sicherheitscode|verification[ \t]*code|one[- \t]?time[ \t]*code)[ \t]*[:：=][ \t]*)([^\n\r]{1,120})"),
    ("aktenzeichen_tail", "REF", "prefix", "giu", r"((?:Aktenzeichen|Geschäftszeichen)[ \t]*[:：=][ \t]*)(?!ERR-)(?!SKU:)((?:[A-Za-z0-9\[\]]+(?:[-_./][A-Za-z0-9\[\]]+){0,10}[-_./]\d{4,}))"),
    ("aktenzeichen", "REF", "prefix", "giu", r"((?:Aktenzeichen|Geschäftszeichen)[ \t]*[:：=][ \t]*)([A-Za-z0-9\-/\.]{6,80})"),
    ("id_label_tail", "REF", "prefix", "giu", r"((?:Antragsnummer|Kundennummer|Rechnungsnummer|Rechnungsnr\.?|Vorgangs-?ID|Referenz|Ticketnummer|Bestellnummer)[ \t]*[:：=][ \t]*)(?!ERR-)(?!SKU:)((?:[A-Za-z0-9\[\]]+(?:[-_./:][A-Za-z0-9\[\]]+){0,10}[-_./:]\d{4,}))"),
    ("id_label", "REF", "prefix", "giu", r"((?:Antragsnummer|Kundennummer|Rechnungsnummer|Rechnungsnr\.?|Vorgangs-?ID|Referenz|Ticketnummer|Bestellnummer)[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-_/:.]{3,80})"),
    ("ref_generic_tail_de", "REF", "whole", "gu", r"\b(?!ERR-)(?!SKU:)([A-Z]{2,6}(?:-[A-Z0-9]{1,12}){1,6}-\d{5,})\b"),
    ("tax_id", "SECRET", "prefix", "giu", r"((?:Steuer-?ID|Steueridentifikationsnummer)[ \t]*[:：=][ \t]*)(\d[\d \t]{8,20}\d)"),
    ("vat_id", "SECRET", "prefix", "giu", r"((?:USt-?IdNr\.?|Umsatzsteuer-?ID)[ \t]*[:：=][ \t]*)(DE[ \t]?\d{8,12})"),
    ("svnr", "SECRET", "prefix", "giu", r"((?:Sozialversicherungsnummer|SV-Nummer|Rentenversicherungsnummer)[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9 \t\-]{5,40})"),
    ("id_card", "SECRET", "prefix", "giu", r"((?:Personalausweis(?:nummer|[- \t]?Nr\.?))[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-]{4,24})"),
    ("passport", "SECRET", "prefix", "giu", r"((?:Reisepass(?:nummer|[- \t]?Nr\.?))[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-]{4,24})"),
    ("driver_license", "SECRET", "prefix", "giu", r"((?:Führerschein(?:nummer|(?:[ \t]*-[ \t]*|[ \t]+)?Nr\.?)|Fuehrerschein(?:nummer|(?:[ \t]*-[ \t]*|[ \t]+)?Nr\.?)|Führerscheinnummer)[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-/]{4,32}|[A-Z]-\d{4,}-\d{2,4})"),
    ("driver_license_bare_short", "SECRET", "prefix", "giu", r"((?:Führerschein(?:-?[ \t]*Nr\.?|nummer)?|Fuehrerschein(?:-?[ \t]*Nr\.?|nummer)?)[ \t]*[:：=]?[ \t]*)([A-Z]-\d{4,}-\d{2,4})"),
    ("driver_license_ocr_label", "SECRET", "prefix", "giu", r"((?:F[ \t]*ü[ \t]*hrerschein(?:nummer|(?:[ \t]*-[ \t]*|[ \t]+)?Nr\.?)|F[ \t]*u[ \t]*ehrerschein(?:nummer|(?:[ \t]*-[ \t]*|[ \t]+)?Nr\.?))[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-/]{4,32}|[A-Z]-\d{4,}-\d{2,4})"),
    ("birthdate", "SECRET", "prefix", "giu", r"((?:Geburtsdatum|Geb\.?[ \t]*Datum)[ \t]*[:：=][ \t]*)(\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2})"),
    ("birthplace", "SECRET", "prefix", "giu", r"((?:Geburtsort)[ \t]*[:：=][ \t]*)([^\n\r]{2,80})"),
    ("birthdate_bare", "SECRET", "prefix", "giu", r"(\bGeburtsdatum[ \t]+)(\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2})"),
    ("birthplace_bare", "SECRET", "prefix", "giu", r"(\bGeburtsort[ \t]+)([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40}(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40}){0,2})"),
    ("id_card_bare", "SECRET", "prefix", "giu", r"(\bPersonalausweisnummer[ \t]+)([A-Za-z0-9][A-Za-z0-9\-]{4,24})"),
    ("passport_bare", "SECRET", "prefix", "giu", r"(\bReisepassnummer[ \t]+)([A-Za-z0-9][A-Za-z0-9\-]{4,24})"),
    ("driver_license_bare", "SECRET", "prefix", "giu", r"(\b(?:Führerschein(?:-?[ \t]*Nr\.?|nummer)?|Fuehrerschein(?:-?[ \t]*Nr\.?|nummer)?)[ \t]+)([A-Za-z0-9][A-Za-z0-9\-/]{4,32}|[A-Z]-\d{4,}-\d{2,4})"),
    ("account", "ACCOUNT", "prefix", "giu", r"((?:IBAN|Kontonummer|Account(?:[ \t]*Number)?)[ \t]*[:：=][ \t]*)([A-Z]{2}\d{2}(?:[ \t\r\n]?[A-Z0-9]{2,5}){3,10}|[A-Z]{2}\d{2}[\d \t\r\n-]{10,40}|\d[\d \t-]{6,40}\d)"),
    ("account_bare_iban", "ACCOUNT", "prefix", "giu", r"(\bIBAN[ \t]+)(DE\d{2}(?:[ \t]?[A-Z0-9]{2,5}){3,10})"),
    ("account_bare_iban_multiline", "ACCOUNT", "prefix", "giu", r"(\bIBAN(?:[ \t]*[:：=])?(?:[ \t]*\r?\n[ \t]*|[ \t]+))((?:DE\d{2}(?:[ \t]*\r?\n?[ \t]*|[ \t]+)?[A-Z0-9]{2,5}){3,10})"),
    ("bank", "ACCOUNT", "prefix", "giu", r"((?:BIC|SWIFT|SWIFT[ \t]*Code)[ \t]*[:：=]?[ \t]*)([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)"),
    ("blz", "ACCOUNT", "prefix", "giu", r"((?:Bankleitzahl|BLZ)[ \t]*[:：=][ \t]*)(\d{5,12})"),
    ("creditcard", "ACCOUNT", "prefix", "giu", r"((?:Kreditkarte|Kartennummer|Card(?:[ \t]*Number)?|Visa|Mastercard|Amex)[ \t]*[:：=][ \t]*)(\d(?:[ -]?\d){12,22}\d)"),
    ("money_negative", "MONEY", "whole", "giu", r"(?:[€$£¥￥][ \t]*[-−]\s*\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?(?![\dA-Za-z])|[-−]\s*\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?[ \t]*\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b(?![\dA-Za-z])|\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b[ \t]*[-−]\s*\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?(?![\dA-Za-z])|[-−]\s*\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?[ \t]*[€$£¥￥](?![\dA-Za-z]))"),
    ("money", "MONEY", "whole", "giu", r"(?:\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b[ \t]*(?:[€$£¥￥][ \t]*)?\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?|\b\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?[ \t]*\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b|[€$£¥￥][ \t]*\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?|\b\d{1,3}(?:[.,' \t]\d{3})*(?:[.,]\d{2})?[ \t]*[€$£¥￥])"),
    ("email", "EMAIL", "whole", "gi", r"\b[A-Z0-9._%+-]+[ \t]*@[ \t]*[A-Z0-9.-]+[ \t]*\.[ \t]*[A-Z]{2,}\b"),
    ("url", "URL", "whole", "giu", r"""\b(?:https?://|www\.)[^\s<>"'）)\]】]+"""),
    ("phone", "PHONE", "phone", "giu", r"((?:tel|telefon|handy|phone|mobile|mobil|whatsapp|telegram|signal|fax)(?:[ \t]*\([^)]+\))?[ \t]*[:：=]?[ \t]*)([+＋]?[ \t]*\d[\d \t().-]{5,}\d)\b|(?<![A-Za-z0-9_-])((?:[+＋][ \t]*\d{1,3}|00[ \t]*[1-9]\d{0,2})[\d \t().-]{6,}\d)\b"),
    ("person_name_keep_title", "NAME", "prefix", "gmiu", r"^((?:Name|Kundename|Kunde|Kontaktperson|Kontakt|Ansprechpartner(?:[ \t]+Dienstleister)?|Ansprechperson|Empfänger|Empf[ \t]*ä[ \t]*nger|Rechnungsempfänger|Rechnungsempf[ \t]*ä[ \t]*nger|Sachbearbeiter|Bearbeiter|Versicherte[ \t]*Person|Patient)[ \t]*[:：=][ \t]*)((?:(?:Herr|Frau|Dr\.?|Prof\.?)\.?[ \t]+)?(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{0,40}){0,3})(?:[ \t]+(?:\([^\n\r]{0,120}\)))?[ \t]*$"),
    ("person_name_inline", "NAME", "prefix", "giu", r"((?:Name|Kundename|Kunde|Kontaktperson|Kontakt|Ansprechpartner(?:[ \t]+Dienstleister)?|Ansprechperson|Empfänger|Empf[ \t]*ä[ \t]*nger|Rechnungsempfänger|Rechnungsempf[ \t]*ä[ \t]*nger|Sachbearbeiter|Bearbeiter|Versicherte[ \t]*Person|Patient)[ \t]*[:：=][ \t]*)((?:(?:Herr|Frau|Dr\.?|Prof\.?)\.?[ \t]+)?(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{0,40}){0,3})(?=[ \t]*(?:[|·]|\n|\r|$))"),
    ("person_name", "NAME", "prefix", "gu", r"((?:Name|Kundename|Kunde|Kontaktperson|Kontakt|Ansprechpartner(?:[ \t]+Dienstleister)?|Ansprechperson|Empfänger|Empf[ \t]*ä[ \t]*nger|Rechnungsempfänger|Rechnungsempf[ \t]*ä[ \t]*nger|Sachbearbeiter|Bearbeiter|Versicherte[ \t]*Person|Patient)[ \t]*[:：=][ \t]*)((?:(?:Herr|Frau|Dr\.?|Prof\.?)[ \t]+)?(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{0,40}){1,3})"),
    ("person_name_broken_ocr", "NAME", "prefix", "gmu", r"((?:Ansprechpartner(?:[ \t]+Dienstleister)?|Empfänger|Empf[ \t]*ä[ \t]*nger|Rechnungsempfänger|Rechnungsempf[ \t]*ä[ \t]*nger|Name|Kundename|Sachbearbeiter)[ \t]*[:：=][ \t]*(?:(?:Herr|Frau|Dr\.?|Prof\.?)\.?[ \t]+)?)([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,20})[ \t]+([äöüÄÖÜß][A-Za-zÄÖÜäöüß'’\-]{1,20})"),
    ("recipient_name_nextline", "NAME", "prefix", "gmu", r"((?:Rechnungsadresse|Lieferadresse|Empfänger|Empf[ \t]*ä[ \t]*nger|Rechnungsempfänger|Rechnungsempf[ \t]*ä[ \t]*nger)[ \t]*[:：=]?[ \t]*(?:\r?\n[ \t]*){1,3})((?:(?:Herr|Frau|Dr\.?|Prof\.?)[ \t]+)?(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{0,40}){0,3})(?=[ \t]*(?:\r?\n))"),
    ("recipient_name_nextline_broken_ocr", "NAME", "whole", "gmu", r"((?:Rechnungsadresse|Lieferadresse|Empfänger|Empf[ \t]*ä[ \t]*nger|Rechnungsempfänger|Rechnungsempf[ \t]*ä[ \t]*nger)[ \t]*[:：=]?[ \t]*(?:\r?\n[ \t]*){1,3}(?:(?:Herr|Frau|Dr\.?|Prof\.?)[ \t]+)?[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,20})[ \t]+([äöüÄÖÜß][A-Za-zÄÖÜäöüß'’\-]{1,20})(?=[ \t]*(?:\r?\n))"),
    ("titled_name_bare", "NAME", "prefix", "gu", r"\b((?:Herr|Frau|Dr\.?|Prof\.?)[ \t]+)((?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40}){0,2})(?=[ \t]*(?:[.,;:)\]]|\n|\r|$))"),
    ("titled_name_bare_broken_ocr", "NAME", "prefix", "gu", r"\b((?:Herr|Frau|Dr\.?|Prof\.?)[ \t]+)([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,20}(?:[ \t]+(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,20}|[äöüÄÖÜß][A-Za-zÄÖÜäöüß'’\-]{1,20})){0,2})(?=[ \t]*(?:[.,;:)\]]|\n|\r|$))"),
    ("titled_name_bare_multiline", "NAME", "prefix", "gu", r"\b((?:Herr|Frau|Dr\.?|Prof\.?)[ \t]+)([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,30})(?:[ \t]*\r?\n[ \t]*|[ \t]+)([A-ZÄÖÜäöüÄÖÜß][A-Za-zÄÖÜäöüß'’\-]{1,30})(?=[ \t]*(?:[.,;:)\]]|\n|\r|$))"),
    ("company_tx_line", "COMPANY", "prefix", "giu", r"((?:Lastschrift|Überweisung|Ueberweisung|Gutschrift|Zahlung|Abbuchung)[ \t]+)((?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9&.\-]*)(?:[ \t]+(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9&.\-]*)){0,6}[ \t]+(?:GmbH(?:[ \t]*&[ \t]*Co\.[ \t]*KG)?|UG(?:[ \t]*\([^)]+\))?|KGaA|OHG|PartG|eG|AG|KG|GbR|e\.K\.?))"),
    ("company_tx_line_broken_ocr", "COMPANY", "prefix", "giu", r"((?:Ü[ \t]*berweisung|Ueberweisung|Lastschrift|Gutschrift|Zahlung|Abbuchung)[ \t]+)((?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9&.\-]*)(?:[ \t]+(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9&.\-]*)){0,6}[ \t]+(?:GmbH(?:[ \t]*&[ \t]*Co\.[ \t]*KG)?|UG(?:[ \t]*\([^)]+\))?|KGaA|OHG|PartG|eG|AG|KG|GbR|e\.K\.?))"),
    ("company_label", "COMPANY", "prefix", "giu", r"((?:Firma|Unternehmen|Firmenname|Handelsname|Firmenbezeichnung|GmbH|AG|KG)[ \t]*[:：=][ \t]*)([^\n\r]+)"),
    ("company", "COMPANY", "company", "giu", r"\b(?<name>(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9&.\-]*)(?:[ \t]+(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9&.\-]*)){0,6})[ \t]+(?<legal>GmbH(?:[ \t]*&[ \t]*Co\.[ \t]*KG)?|UG(?:[ \t]*\([^)]+\))?|KGaA|OHG|PartG|eG|AG|KG|GbR|e\.K\.?)\b"),
    ("address_de_inline_street", "ADDRESS", "whole", "gmu", r"^(?!.*\b(?:Lagerplatz|Regal|Fach|SKU|Fehlercode|ERR|Testwert|Artikel|Gutschrift|Kontonummer|Bankleitzahl|Versichertennummer)\b)([A-ZÄÖÜ][\p{L}.'\-]{1,40}(?:[ \t]+[A-ZÄÖÜ][\p{L}.'\-]{1,40}){0,4}[ \t]+\d{1,4}(?:[ \t]*[A-Za-z])?(?:-\d{1,4})?)$"),
    ("address_de_street_partial", "ADDRESS", "prefix", "giu", r"((?:Adresse|Anschrift|Straße|Strasse|Rechnungsadresse|Lieferadresse)[ \t]*[:：=][ \t]*)([^\n\r]+)"),
    ("address_de_extra_partial", "ADDRESS", "prefix", "giu", r"((?:Zusatz)[ \t]*[:：=][ \t]*)((?=[^\n\r]{2,260})(?=.*\b(?:Gebäude|Haus|Block|Aufgang|Etage|Stock|Stockwerk|OG|EG|DG|WHG|Wohnung|Zimmer|Raum|App\.?|Apartment)\b)[^\n\r]*)(?=,[ \t]*(?:Klingel|Tür|Tel\.?|Telefon)\b)"),
    ("address_de_extra", "ADDRESS", "prefix", "giu", r"((?:Zusatz)[ \t]*[:：=][ \t]*)((?=[^\n\r]{2,140}$)(?=.*\b(?:Gebäude|Haus|Block|Aufgang|Etage|Stock|Stockwerk|OG|EG|DG|WHG|Wohnung|Zimmer|Raum|App\.?|Apartment|Tür|Klingel)\b)[^\n\r]{2,140})"),
    ("address_de_street", "ADDRESS", "prefix", "giu", r"((?:Adresse|Anschrift|Straße|Strasse|Rechnungsadresse|Lieferadresse)[ \t]*[:：=][ \t]*)((?=[^\n\r]{4,140}$)(?=[^\n\r]{0,140}(?:\d{1,4}[ \t]*[A-Za-z]?\b|straße\b|strasse\b|str\.\b|weg\b|platz\b|allee\b|gasse\b|ring\b|ufer\b|damm\b|chaussee\b|promenade\b|markt\b|hof\b|kai\b))[^\n\r]{4,140})"),
    ("klingel_name", "NAME", "prefix", "giu", r"""((?:Klingel)[ \t]*[„"'']?[ \t]*)([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?=[”"'']?)"""),
    ("handle", "HANDLE", "whole", "g", r"@[A-Za-z0-9_]{2,32}\b"),
    ("number", "NUMBER", "whole", "g", r"\b\d[\d \t\-]{6,30}\d\b"),
    ("title", "TITLE", "whole", "g", r"\b(Herr|Frau|Dr\.?|Prof\.?)\b"),
    ("api_key_token", "SECRET", "prefix", "giu", r"((?:api[ \t]*key|x-api-key|access[ \t]*token|refresh[ \t]*token|token|auth[ \t]*token|client[ \t]*secret|secret[ \t]*key|schlüssel|schluessel)[ \t]*[:：=]?[ \t]+)([A-Za-z0-9._\-]{8,300})"),
    ("access_token_bare", "SECRET", "prefix", "giu", r"(\bAccess[ \t]*Token(?:[ \t]*[:：=])?(?:[ \t]*(?:\r?\n[ \t]*){1,3}|[ \t]+))([A-Za-z0-9._\-]{8,300})"),
    ("bearer_token", "SECRET", "prefix", "giu", r"(\bauthorization[ \t]*[:：=][ \t]*bearer[ \t]+)([A-Za-z0-9._\-]{8,400})"),
    ("security_answer", "SECRET", "prefix", "giu", r"((?:Sicherheitsantwort|Antwort|security[ \t]*answer|answer)[ \t]*[:：=][ \t]*)([^\n\r]{1,160})"),
    ("ip_label", "SECRET", "prefix", "giu", r"((?:IP(?:[ \t]*Adresse|Address)?|IPv4|IPv6)[ \t]*[:：=][ \t]*)((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4})"),
    ("ip_address", "SECRET", "whole", "giu", r"\b((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4})\b"),
    ("mac_label", "SECRET", "prefix", "giu", r"((?:MAC(?:[ \t]*Adresse|Address)?)[ \t]*[:：=][ \t]*)(\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b)"),
    ("mac_address", "SECRET", "whole", "giu", r"\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b"),
    ("imei2", "SECRET", "prefix", "giu", r"((?:IMEI)[ \t]*[:：=][ \t]*)(\d{14,16})"),
    ("device_fingerprint", "SECRET", "prefix", "giu", r"((?:Geräte-?ID|Geraete-?ID|Device[ \t]*ID|Session[ \t]*ID|Sitzungs-?ID|Fingerprint|Browser-?Fingerprint|User-?Agent)[ \t]*[:：=][ \t]*)([^\n\r]{1,220})"),
    ("session_id_bare", "SECRET", "prefix", "giu", r"(\bSession[ \t]*ID(?:[ \t]*[:：=])?(?:[ \t]*(?:\r?\n[ \t]*){1,3}|[ \t]+))([A-Za-z0-9._\-]{6,220})"),
    ("uuid2", "SECRET", "whole", "giu", r"\b([0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})\b"),
    ("bank_routing_ids", "ACCOUNT", "prefix", "giu", r"((?:Clearing[ \t]*(?:nummer|number|no\.?)|Clearing|Zentralbank-?Nr\.?|Filial-?Code|Filialnummer|Branch[ \t]*Code|Transit[ \t]*Number|BSB|ABA(?:[ \t]*(?:Number|Routing[ \t]*Number))?)[ \t]*[:：=][ \t]*)([0-9][0-9 \t-]{2,24}[0-9])"),
    ("avs_data", "SECRET", "prefix", "giu", r"((?:AVS[ \t]*Data)[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{1,40})"),
    ("three_ds_status", "SECRET", "prefix", "giu", r"((?:3-?D[ \t]*Secure|3DS)(?:[ \t]*Status)?[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{1,40})"),
    ("eci", "SECRET", "prefix", "giu", r"((?:ECI)[ \t]*[:：=][ \t]*)(\d{2})"),
    ("legal_ref_tail", "REF", "prefix", "giu", r"((?:(?:Vertragsnummer|Vertrag[ \t]*Nr\.?|Schadensnummer|Schaden[ \t]*Nr\.?|Rechtsfall[ \t]*Ref|Legal[ \t]*Case[ \t]*Ref|Claim[ \t]*Reference|Contract[ \t]*Number)[ \t]*[:：=][ \t]*))(?!ERR-)(?!SKU:)((?:[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,8}[-_.]\d{4,}))"),
    ("insurance_id2", "SECRET", "prefix", "giu", r"((?:Versicherungs(?:nummer|nr\.?)|Police(?:n)?nummer|Policen(?:nr\.?)|Policy[ \t]*(?:ID|No\.?|Number)|Member[ \t]*(?:ID|No\.?|Number))[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-_.]{3,60})"),
    ("wallet_id", "SECRET", "prefix", "giu", r"((?:Wallet[ \t]*ID)[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{3,80})"),
    ("tx_hash", "SECRET", "prefix", "giu", r"((?:Transaction[ \t]*Hash|TX[ \t]*Hash|Txn[ \t]*Hash)[ \t]*[:：=][ \t]*)(0x[0-9a-f]{16,128})"),
    ("crypto_wallet", "SECRET", "prefix", "giu", r"((?:BTC|ETH)[ \t]*[:：=][ \t]*)((?:bc1)[0-9a-z]{25,90}|[13][A-HJ-NP-Za-km-z1-9]{25,34}|0x[a-f0-9]{40})"),
    ("account_holder_name_keep_title", "NAME", "prefix", "gmiu", r"^((?:Kontoinhaber)[ \t]*[:：=][ \t]*)((?:(?:Herr|Frau|Dr\.?|Prof\.?)\.?[ \t]+)?(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{1,40})(?:[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'’\-]{0,40}){0,3})(?:[ \t]+(?:\([^\n\r]{0,120}\)))?[ \t]*$"),
    ("birthplace_optional_secret", "SECRET", "prefix", "giu", r"((?:Geburtsort)[ \t]*[:：=][ \t]*)([^\n\r]{2,80})"),
    ("blz_paren", "ACCOUNT", "prefix", "giu", r"((?:Bankleitzahl)[ \t]*(?:\([ \t]*BLZ[ \t]*\))?[ \t]*[:：=][ \t]*)(\d{5,12})"),
    ("card_expiry_de", "SECRET", "prefix", "giu", r"((?:Gültig[ \t]*bis|Gueltig[ \t]*bis|Ablaufdatum|Expiry|Expiration|Exp(?:iry|iration)?(?:[ \t]*Date)?|Valid[ \t]*Thru|Valid[ \t]*Through)[ \t]*[:：=][ \t]*)(\d{2}[ \t]*/[ \t]*\d{2,4}|\d{2}[ \t]*-[ \t]*\d{2,4}|\d{4}[ \t]*-[ \t]*\d{2})"),
    ("card_security_de", "SECRET", "prefix", "giu", r"((?:CVC|CVV|CVC2|CAV2)[ \t]*[:：=][ \t]*)(\d{3,4})"),
]
