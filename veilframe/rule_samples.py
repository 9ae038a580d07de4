"""A line for each live rule whose hit is known beforehand, and a near miss: every rule against expected places in closed form.

Customers are dealt over a language's lines; a filler of varying length stands before the line, so places differ from row to row.
The SQL knows only where the value was put, not the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import spans
from .plans.config import PACKS, ScrubConfig
from .queries import spread, table

#: Lines by language: key, what stands before the value, the value ("" where the rule must find none), what follows it.
SAMPLES: dict[str, list[tuple[str, str, str, str]]] = {
    "en": [
        ("email", "write to ", "ann.lee+x@mail.example.org", " soon"),
        ("url", "see ", "https://a.example.com/p?q=1", " there"),
        ("money_label", "Total due: ", "USD 1,250.00", ""),
        ("money_negative", "booked ", "EUR -12.50", " again"),
        ("money", "worth ", "$1,234,567.89", " in all"),
        ("secret", "Recovery code: ", "maple-77 blue", ""),
        ("api_key_token", "Client secret: ", "ab12.cd34_ef-56", ""),
        ("bearer_token", "Authorization: Bearer ", "eyJhbGciOi.J9-x_1", ""),
        ("handle_label", "Login ID: ", "ann_lee.77", ""),
        ("dob", "Date of birth: ", "1984-03-07", ""),
        ("place_of_birth", "Birthplace: ", "Port Harmon", ""),
        ("passport", "Passport no.: ", "K1234567", ""),
        ("driver_license", "Driver's license number: ", "D-9981-220", ""),
        ("ssn", "Social security number: ", "123-45-6789", ""),
        ("ein", "EIN: ", "12-3456789", ""),
        ("national_id", "National ID no.: ", "NX-4401.b", ""),
        ("tax_id", "TIN: ", "TX99-10021", ""),
        ("insurance_id", "Member ID: ", "M_22-901", ""),
        ("intl_itin", "US ITIN: ", "912-70-1234", ""),
        ("intl_nino", "UK NINO: ", "QQ 12 34 56 C", ""),
        ("intl_nhs", "NHS number: ", "943 476 5919", ""),
        ("intl_sin", "CA SIN: ", "046 454 286", ""),
        ("intl_tfn", "AU TFN: ", "123 456 782", ""),
        ("intl_abn", "ABN: ", "51 824 753 556", ""),
        ("uuid", "run ", "123e4567-e89b-42d3-a456-426614174000", " ended"),
        ("ip_label", "IPv4: ", "192.168.10.254", ""),
        ("ip_address", "host ", "10.20.30.40", " answers"),
        ("mac_label", "MAC address: ", "00:1A:2B:3C:4D:5E", ""),
        ("mac_address", "card ", "00-1A-2B-3C-4D-5E", " found"),
        ("imei", "IMEI: ", "490154203237518", ""),
        ("device_fingerprint", "Device ID: ", "dev 77/b", ""),
        ("account", "Sort code ", "20-00-00-55779911", ""),
        ("bank", "SWIFT code: ", "DEUTDEFF500", ""),
        ("bank_routing_ids", "Transit number: ", "000 12-345", ""),
        ("card_expiry", "Valid thru: ", "09 / 2031", ""),
        ("card_security", "CVV: ", "123", ""),
        ("avs_data", "AVS data: ", "Y.10_a", ""),
        ("three_ds_status", "3-D Secure status: ", "passed", ""),
        ("eci", "ECI: ", "05", ""),
        ("security_answer", "Security answer: ", "first dog Rex", ""),
        ("phone", "Mobile: ", "+44 20 7946 0958", ""),
        ("phone", "Contact: ", "", "12345678901234567"),
        ("person_name", "Sales manager: ", "Dr. Ann Lee", ""),
        ("person_name_inline", "Attn.: ", "Ann O'Neil", ""),
        ("person_name_plain_label", "Name: ", "Bo Karlsen", ""),
        ("person_name_plain_label", "Company Name: ", "", "Bo Karlsen"),
        ("person_name_title_line", "Mrs. ", "Ada Byron", ""),
        ("company_label", "Supplier: ", "North Sea Parts", ""),
        ("company", "", "Harbor Mills", " Ltd"),
        ("address_de_street", "Mailing address: ", "4 Elm Road, Bath", ""),
        ("address_de_postal", "Postcode: ", "SW1A 1AA", ""),
        ("address_en_street_line", "", "Old Mill Lane 12b", ""),
        ("address_en_inline_street", "lives at ", "221B Baker Street", ", upstairs"),
        ("address_en_extra_block", "is in ", "Suite: 4B-2", ", left"),
        ("address_en_extra", "is in ", "building #7", ", left"),
        ("ref_generic_multi_tail", "under ", "ABC-X1-20240101-0042", " since"),
        ("ref_generic_multi_tail", "under ", "", "ERR-X1-20240101-0042"),
        ("ref_label_multi_tail", "Invoice no. - ", "INV.2024.0042", ""),
        ("ref_label_nextline", "Order number:\n", "PO-77-20031", ""),
        ("ref_label_tail", "Ticket ID: ", "TK-88_12345", ""),
        ("ref_label_tail", "Ticket ID: ", "", "SKU:88_12345"),
        ("ref_generic_tail", "under ", "CASE-B2-99812", " since"),
        ("legal_ref_tail", "Claim reference: ", "CL.9-20241", ""),
        ("handle", "ask ", "@ann_lee", " first"),
        ("wallet_id", "Wallet ID: ", "w-99.a_1", ""),
        ("tx_hash", "TX hash: ", "0x0123456789abcdef01", ""),
        ("crypto_wallet", "ETH: ", "0x00112233445566778899aabbccddeeff00112233", ""),
        ("number", "row ", "4400 1122-3344", " read"),
    ],
    "de": [
        ("login", "Benutzername: ", "anna.k", ""),
        ("secret", "Kennwort: ", "Birne 77", ""),
        ("aktenzeichen_tail", "Aktenzeichen: ", "VG/12-2024.0042", ""),
        ("aktenzeichen_tail", "Aktenzeichen: ", "", "ERR-2024.0042"),
        ("id_label_tail", "Bestellnummer: ", "B-77:20031", ""),
        ("ref_generic_tail_de", "unter ", "KND-A1-99812", " geführt"),
        ("tax_id", "Steueridentifikationsnummer: ", "12 345 678 901", ""),
        ("vat_id", "USt-IdNr.: ", "DE 123456789", ""),
        ("svnr", "Rentenversicherungsnummer: ", "65 170839 J 003", ""),
        ("id_card", "Personalausweis-Nr.: ", "L01X00T47", ""),
        ("passport", "Reisepass Nr.: ", "C01X00T47", ""),
        ("driver_license", "Führerscheinnummer: ", "B072RRE2I55", ""),
        ("driver_license_bare_short", "Führerschein Nr. ", "B-12345-67", ""),
        ("driver_license_ocr_label", "F ü hrerschein-Nr.: ", "J010000SD51", ""),
        ("birthdate", "Geb. Datum: ", "7.3.1984", ""),
        ("birthplace", "Geburtsort: ", "Bad Münder", ""),
        ("birthdate_bare", "Geburtsdatum ", "1984-03-07", " laut Akte"),
        ("birthplace_bare", "Geburtsort ", "Köln", ", laut Akte"),
        ("id_card_bare", "Personalausweisnummer ", "L01X00T47", ""),
        ("passport_bare", "Reisepassnummer ", "C01X00T47", ""),
        ("driver_license_bare", "Führerscheinnummer ", "B072RRE2I55", ""),
        ("account", "Kontonummer: ", "0532 0130 00", ""),
        ("account_bare_iban", "IBAN ", "DE89 3704 0044 0532 0130 00", ""),
        ("account_bare_iban_multiline", "IBAN:\n", "DE893704DE440532DE013000", ""),
        ("bank", "BIC ", "COBADEFF", ""),
        ("blz", "BLZ: ", "37040044", ""),
        ("creditcard", "Kreditkarte: ", "4111 1111 1111 1111", ""),
        ("money_negative", "gebucht ", "-12,50 EUR", " heute"),
        ("money", "zahlt ", "1.234.567,89 EUR", " heute"),
        ("email", "an ", "anna.k@post.example.de", " senden"),
        ("url", "siehe ", "www.laden.example.de/a", " dort"),
        ("phone", "Handy: ", "0171 2345678", ""),
        ("phone", "Tel: ", "", "1234567890123456"),
        ("phone", "unter ", "+49 30 1234567", ""),
        ("person_name_keep_title", "Sachbearbeiter: ", "Frau Anna Klein", ""),
        ("person_name_inline", "Patient: ", "Jörg Groß", ""),
        ("person_name", "Ansprechpartner: ", "Anna Klein", ""),
        ("person_name_broken_ocr", "Kundename: ", "Anna", " östen"),
        ("person_name_broken_ocr", "Kundename: J ", "", "ürgen"),
        ("recipient_name_nextline", "Lieferadresse:\n", "Anna Klein", "\nHof"),
        ("recipient_name_nextline_broken_ocr", "", "Lieferadresse:\nAnna östen", "\nHof"),
        ("titled_name_bare_multiline", "von Frau ", "Anna", "\nKlein, bitte"),
        ("titled_name_bare", "von Frau ", "Anna Klein", ", bitte"),
        ("titled_name_bare_broken_ocr", "von Herr ", "Bernd östen", ", bitte"),
        ("company_tx_line", "Lastschrift ", "Nordlicht Strom GmbH", ""),
        ("company_tx_line_broken_ocr", "Ü berweisung ", "Nordlicht Strom AG", ""),
        ("company_label", "Unternehmen: ", "Nordlicht Handel", ""),
        ("company", "", "Nordlicht Strom", " GmbH"),
        ("address_de_inline_street", "", "Lange Gasse 12a", ""),
        ("address_de_inline_street", "", "", "Regal Gasse 12a"),
        ("address_de_street_partial", "Anschrift: ", "Lange Gasse 12, Ulm", ""),
        ("address_de_extra_partial", "Zusatz: ", "Haus B, 3. OG", ", Klingel Klein"),
        ("klingel_name", "Klingel \"", "Klein", "\""),
        ("handle", "frag ", "@anna_k", " zuerst"),
        ("number", "Zeile ", "4400 1122-3344", " lesen"),
        ("api_key_token", "Access Token: ", "ab12.cd34_ef", ""),
        ("access_token_bare", "Access Token\n", "ab12.cd34_ef", ""),
        ("bearer_token", "Authorization: Bearer ", "eyJhbGciOi.J9", ""),
        ("security_answer", "Sicherheitsantwort: ", "Hund Rex", ""),
        ("ip_label", "IP Adresse: ", "192.168.10.254", ""),
        ("ip_address", "Rechner ", "10.20.30.40", " antwortet"),
        ("mac_label", "MAC Adresse: ", "00:1A:2B:3C:4D:5E", ""),
        ("mac_address", "Karte ", "00-1A-2B-3C-4D-5E", " gefunden"),
        ("imei2", "IMEI: ", "490154203237518", ""),
        ("device_fingerprint", "Geräte-ID: ", "dev 77/b", ""),
        ("session_id_bare", "Session ID\n", "s-99.a_1x", ""),
        ("uuid2", "Lauf ", "123e4567-e89b-42d3-a456-426614174000", " beendet"),
        ("bank_routing_ids", "Filialnummer: ", "000 12-345", ""),
        ("avs_data", "AVS Data: ", "Y.10_a", ""),
        ("three_ds_status", "3DS Status: ", "ok", ""),
        ("eci", "ECI: ", "05", ""),
        ("legal_ref_tail", "Schadensnummer: ", "SCH-9-20241", ""),
        ("insurance_id2", "Versicherungsnummer: ", "V_22-901", ""),
        ("wallet_id", "Wallet ID: ", "w-99.a_1", ""),
        ("tx_hash", "TX Hash: ", "0x0123456789abcdef01", ""),
        ("crypto_wallet", "BTC: ", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", ""),
        ("account_holder_name_keep_title", "Kontoinhaber: ", "Dr. Anna Klein", ""),
        ("birthplace_optional_secret", "Geburtsort: ", "Bad Münder", ""),
        ("blz_paren", "Bankleitzahl (BLZ): ", "37040044", ""),
        ("card_expiry_de", "Gültig bis: ", "09/31", ""),
        ("card_security_de", "CVC2: ", "123", ""),
    ],
    "zh": [
        ("email", "写信至 ", "ann.lee@mail.example.cn", " 即可"),
        ("url", "见 ", "https://a.example.cn/p", " 页"),
        ("secret", "登录密码：", "fengye 77", ""),
        ("security_answer", "密保答案：", "小狗旺财", ""),
        ("api_key_token_zh", "访问令牌：", "ab12.cd34_ef", ""),
        ("secret_inline_zh", "设备ID\n", "device_9912ab", ""),
        ("dob", "出生日期：", "1984年3月7日", ""),
        ("place_of_birth", "籍贯：", "江苏南京", ""),
        ("id_card", "身份证号：", "11010519491231002X", ""),
        ("id_card_inline_zh", "居民身份证 ", "110105194912310021", ""),
        ("passport", "护照号：", "E12345678", ""),
        ("passport_inline_zh", "护照号 ", "E12345678", ""),
        ("driver_license", "驾驶证号：", "11010519491231002X", ""),
        ("driver_license_inline_zh", "驾驶证号 ", "JX-99120", ""),
        ("license_plate", "车牌号：", "京A12345", ""),
        ("license_plate_inline_zh", "车牌 ", "沪B6789X", ""),
        ("tax_id_zh", "税号：", "91310000MA1K", ""),
        ("cust_id", "客户ID：CUST-", "00991234", ""),
        ("ref_label_tail", "订单号：", "PO-77-20031", ""),
        ("ref_label_tail", "订单号：", "", "SKU:77-20031"),
        ("ref_inline_zh", "合同编号 ", "HT.2024-0042", ""),
        ("account", "银行账号：", "6222 0212 3456 7890", ""),
        ("account_cn_inline", "路由号\n", "0210 00021", ""),
        ("bank", "SWIFT：", "BKCHCNBJ", ""),
        ("bank_routing_ids", "联行号：", "1021 0000-99", ""),
        ("card_expiry", "有效期：", "09/31", ""),
        ("card_security", "CVV：", "123", ""),
        ("phone", "联系电话：", "021-5555 0199", ""),
        ("phone", "订单电话：", "", "1234567890123456"),
        ("person_name", "收件人：", "王小明", ""),
        ("person_name", "收件人：", "", "长江贸易有限公司"),
        ("person_name_address_block", "收货地址：\n", "王小明", "\n"),
        ("address_cn", "", "居住地址：江苏省南京市中山路12号", ""),
        ("address_cn_block", "", "办公地址：\n王小明\n江苏省南京市玄武区中山路12号", "\n"),
        ("address_cn_block_multiline", "", "办公地址：\n王小明\n江苏省南京市中山路甲12号", "\n"),
        ("address_inline_zh", "住 ", "江苏省南京市中山路12号内", ""),
        ("handle_label", "微信号：", "wx_ann-77", ""),
        ("money_label", "合计：", "1,234.50", ""),
        ("money_label_currency_zh", "人民币：", "1,234.5", ""),
        ("money_cn_inline_label", "首付款 ", "50,000", ""),
        ("money", "共 ", "￥1,234.50", " 整"),
        ("company_label_inline_zh", "供应商：", "长江贸易有限公司", ""),
        ("company_label_inline_zh_no_colon", "甲方 ", "长江贸易有限公司", ""),
        ("company", "", "长江贸易", "有限公司"),
        ("company_block", "收款方：\n", "长江贸易有限公司", "\n"),
        ("ip_label", "IP地址：", "192.168.10.254", ""),
        ("ip_address", "主机 ", "10.20.30.40", " 应答"),
        ("mac_label", "MAC地址：", "00:1A:2B:3C:4D:5E", ""),
        ("mac_address", "网卡 ", "00-1A-2B-3C-4D-5E", " 在"),
        ("imei", "IMEI：", "490154203237518", ""),
        ("device_fingerprint", "指纹：", "dev 77/b", ""),
        ("uuid", "编号 ", "123e4567-e89b-42d3-a456-426614174000", " 完"),
        ("wallet_id", "钱包ID：", "w-99.a_1", ""),
        ("tx_hash", "交易哈希：", "0x0123456789abcdef01", ""),
        ("crypto_wallet", "以太坊：", "0x00112233445566778899aabbccddeeff00112233", ""),
        ("handle", "问 ", "@ann_lee", " 吧"),
        ("number", "行 ", "4400 1122-3344", " 读"),
    ],
}


def sample_texts(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """``doc_id, key, text``: each customer's line, by the remainder of its key."""
    told = SAMPLES[lang]
    lines = spark.createDataFrame([(n, key, head + value + tail) for n, (key, head, value, tail) in enumerate(told)], "n long, key string, line string")
    dealt = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % len(told)).alias("n"))
    filler = F.concat(F.expr("repeat('~', cast(doc_id % 5 AS int))"), F.lit("\n"))
    return dealt.join(F.broadcast(lines), "n").select("doc_id", "key", F.concat(filler, "line").alias("text"))  # as many lines as there are rules


def rule_samples(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    """Hits of each line's own rule, all rules being run: ``doc_id, key, start, end, value``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = ScrubConfig(lang=lang, enabled=frozenset(PACKS[lang].PRIORITY))
        lines = sample_texts(spark, sf_dir, lang).select("doc_id", "key", spans.unmarked(F.col("text")).alias("_text"))
        hits = lines.select("doc_id", "key", F.explode_outer(spans.raw_hits("_text", config)).alias("h")).where("h.key = key")
        return hits.select("doc_id", "key", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), F.col("h.text").alias("value"))

    return query


def rule_samples_sql(lang: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ", ".join(f"({n}, '{key}', {quote(head)}, {quote(value)})" for n, (key, head, value, _) in enumerate(SAMPLES[lang]) if value)
    at = "c_custkey % 5 + 1 + length(head)"
    return f"""
WITH s(n, key, head, value) AS (VALUES {rows})
SELECT c_custkey AS doc_id, key, CAST({at} AS BIGINT) AS start, CAST({at} + length(value) AS BIGINT) AS "end", value FROM customer JOIN s ON s.n = c_custkey % {len(SAMPLES[lang])}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_samples_{lang}": rule_samples(lang) for lang in SAMPLES}
ORACLES: dict[str, str] = {f"rule_samples_{lang}": rule_samples_sql(lang) for lang in SAMPLES}
