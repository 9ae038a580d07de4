"""Labels that may stand at the start of a covered value, by language and key: they are not part of the value."""

from __future__ import annotations

from dataclasses import replace

from .tuning import BoxTuning, language_tuning

# Fixed values, in the order in which they are tried: the first that fits is taken, also where a longer one follows it.  Only keys that have a rule and are not covered whole.
LABELS: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "phone": ("Telephone", "WhatsApp", "Telegram", "Signal", "Phone", "Mobile", "Contact", "Tel", "Cell", "Fax"),
        "account": ("Account Number", "Routing Number", "Bank Account", "Sort Code", "Credit Card", "Debit Card", "Name on Card", "Card Number", "Account No", "Account", "IBAN"),
        "email": ("Email Address", "E-mail", "Email"),
        "bank": ("Bank Name", "SWIFT/BIC", "Swift Code", "BIC Code", "Bank", "BIC", "SWIFT"),
        "passport": ("Passport Number", "Passport No", "Passport"),
        "driver_license": ("Driver License", "Driver's License", "License", "DL"),
        "dob": ("Date of Birth", "Birth Date", "DOB"),
        "company": ("Registered Company", "Billing Company", "Legal Entity", "Company Name", "Organization", "Supplier", "Company"),
        "money": (
            "Contract Amount", "Service Fee", "Tax Amount", "Total Amount", "Grand Total", "Subtotal", "Total Due", "Amount", "Balance", "Payment", "Refund", "Charge", "Price", "Paid", "Due", "Net", "Gross", "Tax", "VAT", "USD",
            "Fee",
        ),
        "handle": ("Username", "User ID", "Login ID", "Handle", "User", "Login"),
        "person_name": (
            "Account Manager", "Sales Manager", "Support Agent", "Contact Person", "Customer Name", "Contact Name", "Full Name", "Account Holder", "Name on Card", "Recipient", "Attention", "Attn", "Manager", "Contact", "Customer",
            "Agent", "Name", "To",
        ),
        "place_of_birth": ("Place of Birth", "Birthplace"),
        "secret": (
            "Security Answer", "Transaction Hash", "Wallet ID", "Device ID", "Session ID", "IP Address", "MAC Address", "Access Token", "Refresh Token", "x-api-key", "Verification Code", "Security Code", "One-Time Code",
            "Recovery Code", "Backup Code", "Social Security Number", "Employer Identification Number", "National ID", "ID Number", "Tax Identification Number", "Insurance ID", "Policy ID", "Claim ID", "Member ID", "Membership ID",
            "ITIN", "NHS Number", "NINO", "SIN", "TFN", "ABN", "IMEI", "IPv4", "IPv6", "Fingerprint", "User Agent", "Account Number", "Routing Number", "Sort Code", "IBAN", "Credit Card", "Debit Card", "Card Number",
            "Name on Card", "SWIFT Code", "BIC Code", "Bank Name", "Branch Code", "Clearing Number", "Transit Number", "BSB", "ABA", "Expiry Date", "Expiration Date", "Valid Thru", "Valid Through", "CVV", "CVC", "AVS Data",
            "3-D Secure", "3DS", "ECI", "Authorization", "Secret Key", "Client Secret", "Auth Token", "Token", "API Key", "Password", "Passcode", "PIN", "OTP", "2FA", "Secret", "SSN", "EIN", "TIN", "BTC", "ETH", "TXN Hash",
            "TX Hash",
        ),
    },
    "de": {
        "phone": ("Telefon", "Tel", "Handy", "Mobil", "Mobile", "Phone", "Kontakt", "Mobiltelefon", "Festnetz", "Fax", "Telefonnummer", "Rufnummer"),
        "account": (
            "Konto", "Kontonummer", "Account", "IBAN", "Kontoinhaber", "Bankverbindung", "Kreditkarte", "Kartennummer", "Kreditkartennummer", "Kreditkarten-Nr.", "Kreditkartentyp", "Karteninhaber", "CVC", "CVV", "CVC2", "CAV2",
        ),
        "email": ("E-mail", "Email", "E-Mail", "Mail", "E-Mail-Adresse", "Mailadresse", "Kontakt-E-Mail", "Kunden-E-Mail"),
        "bank": ("Bank", "Bankname", "BIC", "SWIFT", "Bankleitzahl", "BLZ", "Kreditinstitut", "Bankverbindung", "Bankleitzahl (BLZ)", "SWIFT-Code", "SWIFT/BIC", "BIC/SWIFT"),
        "person_name": (
            "Name", "Kundename", "Kunde", "Kontaktperson", "Kontakt", "Ansprechpartner", "Ansprechperson", "Sachbearbeiter", "Bearbeiter", "Empfänger", "Rechnungsempfänger", "Versicherte Person", "Patient", "Kontoinhaber",
        ),
        "company": (
            "Firma", "Unternehmen", "GmbH", "AG", "GmbH & Co. KG", "UG", "KGaA", "OHG", "PartG", "eG", "GbR", "e.K.", "Company", "Organization", "Supplier", "Legal Entity", "Registered Company", "Billing Company", "Firmenname",
            "Firmenbezeichnung", "Handelsname",
        ),
        "money": (
            "Betrag", "Preis", "Gesamtbetrag", "Zwischensumme", "Umsatzsteuer", "Gutschrift", "Summe", "Total", "Netto", "Brutto", "Rechnungsbetrag", "Zahlungsbetrag", "Kosten", "Gebühr", "Rabatt", "Nachlass",
            "Einrichtungsgebühr", "Monatliche Rate", "Vertragswert", "Kulanznachlass", "Service Fee", "Tax Amount", "Total Amount", "Contract Amount", "Amount",
        ),
        "handle": ("User", "Benutzername", "Login", "Username", "Account", "Login-ID", "User-ID", "Benutzerkennung", "Loginname", "Kontoname", "Handle"),
        "id_card": ("ID", "Identifikation", "Personalausweis", "Personalausweisnummer", "Ausweisnummer", "Ausweis", "ID-Nummer", "Identifikationsnummer"),
        "passport": ("Pass", "Reisepass", "Reisepassnummer", "Passnummer", "Pass-Nr."),
        "driver_license": ("Führerschein", "Führerscheinnummer", "Führerschein-Nr.", "Fuehrerschein", "Führerscheinklasse", "Fahrerlaubnis", "Fahrerlaubnisnummer"),
        "secret": (
            "Geheim", "API Key", "Access Token", "Session ID", "Device ID", "IP Adresse", "MAC Adresse", "Passwort", "Kennwort", "PIN", "TAN", "OTP", "2FA", "Sicherheitscode", "Client Secret", "Auth Token", "Authorization",
            "Bearer", "Security Answer", "Answer", "Sicherheitsantwort", "Antwort", "Zugangsdaten", "Login-Daten", "Authentifizierungscode", "Bestätigungscode", "Transaktionsnummer", "Transaction Number", "Geheimcode",
            "Geheimzahl", "Persönliche Identifikationsnummer",
        ),
    },
    "zh": {
        "bank": ("开户行", "開戶銀行", "开户银行", "银行", "銀行", "Bank", "Bank Name", "SWIFT", "BIC", "Swift Code", "BIC Code"),
        "license_plate": ("车牌号", "车牌号码", "号牌号码", "车牌", "号牌"),
        "company": (
            "公司名称", "公司名稱", "单位名称", "單位名稱", "供应商", "供應商", "开票方", "開票方", "收款方", "付款方", "法务顾问单位", "项目服务机构", "項目服務機構", "开户名", "账户名", "帳戶名", "開戶名", "甲方", "乙方", "发货方", "商户", "商戶", "公司", "企业",
            "集团", "有限公司", "股份有限公司", "有限责任公司", "分公司", "事务所", "中心", "企业名称", "组织机构", "法人名称", "公司全称", "公司名", "单位名", "商户名称", "商家名称",
        ),
        "handle": ("用户名", "用 户 名", "用户ID", "用户 ID", "用户", "登录账号", "登 录 账 号", "账号名", "账 号 名", "账号", "支付账号", "支付账户", "微信号", "WeChat ID", "wxid", "User ID"),
        "person_name": ("姓名", "收件人", "联系人", "Name", "Recipient", "开户名", "账户名"),
        "place_of_birth": ("出生地", "籍贯", "出生地点", "Birth Place", "Place of Birth"),
    },
}


def labelled_tuning(lang: str, **overrides) -> BoxTuning:
    """A language's tuning with its labels: what ``device_rects`` needs for values that still begin with their label.

    As in the original a label needs no word end, so ``Tomas`` loses ``To`` where the key is ``person_name``; :func:`language_tuning` without labels is the safe choice for values that begin after theirs.
    """
    base = language_tuning(lang, **overrides)
    return replace(base, labels={**LABELS.get(lang, {}), **base.labels})
