"""Recognizer catalogue: patterns with base scores, and the context words that raise them."""

from __future__ import annotations

# Entity type, ((base score, pattern), ...), (context words, ...).
RECOGNIZERS: tuple[tuple[str, tuple[tuple[float, str], ...], tuple[str, ...]], ...] = (
    (
        'AU_ABN',
        (
            (0.1, r"\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b"),
            (0.01, r"\b\d{11}\b"),
        ),
        ("australian business number", "abn",),
    ),
    (
        'AU_ACN',
        (
            (0.1, r"\b\d{3}\s\d{3}\s\d{3}\b"),
            (0.01, r"\b\d{9}\b"),
        ),
        ("australian company number", "acn",),
    ),
    (
        'AU_MEDICARE',
        (
            (0.1, r"\b[2-6]\d{3}\s\d{5}\s\d\b"),
            (0.01, r"\b[2-6]\d{9}\b"),
        ),
        ("medicare",),
    ),
    (
        'AU_TFN',
        (
            (0.1, r"\b\d{3}\s\d{3}\s\d{3}\b"),
            (0.01, r"\b\d{9}\b"),
        ),
        ("tax file number", "tfn",),
    ),
    (
        'CA_SIN',
        (
            (0.05, r"\b[1-79]\d{8}\b"),
            (0.5, r"\b[1-79]\d{2}([- ])\d{3}\1\d{3}\b"),
        ),
        ("sin", "sin number", "social insurance", "social insurance number", "canada", "nas", "numéro nas", "numéro d'assurance sociale", "assurance sociale",),
    ),
    (
        'FI_PERSONAL_IDENTITY_CODE',
        (
            (0.5, r"\b(\d{6})([+-ABCDEFYXWVU])(\d{3})([0123456789ABCDEFHJKLMNPRSTUVWXY])\b"),
            (0.1, r"(\d{6})([+-ABCDEFYXWVU])(\d{3})([0123456789ABCDEFHJKLMNPRSTUVWXY])"),
        ),
        ("hetu", "henkilötunnus", "personbeteckningen", "personal identity code",),
    ),
    (
        'DE_BSNR',
        (
            (0.2, r"\b\d{9}\b"),
        ),
        ("betriebsstättennummer", "betriebsstätten-nummer", "bsnr", "betriebsstätte", "praxisnummer", "arztpraxis", "praxis", "kassenärztliche vereinigung", "kv-nummer", "kv nummer", "praxisadresse", "praxisstandort", "nebenbetriebsstätte", "hauptbetriebsstätte", "behandlungsort", "vertragsarztpraxis",),
    ),
    (
        'DE_FUEHRERSCHEIN',
        (
            (0.35, r"\b[A-Z]{2}\d{8}[A-Z0-9]\b"),
        ),
        ("führerscheinnummer", "führerschein", "fahrerlaubnis", "fahrerlaubnisnummer", "fahrerlaubnisklasse", "führerscheininhaber", "fev", "kba", "kraftfahrt-bundesamt", "driving licence", "driving license", "driver's license", "licence number", "license number", "dokument nr", "dokument-nr", "feld 5",),
    ),
    (
        'DE_HANDELSREGISTER',
        (
            (0.5, r"\bHR[AB]\s*\d{1,6}\b"),
        ),
        ("handelsregister", "handelsregisternummer", "amtsgericht", "registergericht", "hra", "hrb", "hr-nummer", "registerauszug", "handelsregistereintrag", "firma", "gesellschaft", "gmbh", "ag", "ug", "kg", "ohg", "einzelkaufmann", "einzelkauffrau", "handelsregisterblattnummer",),
    ),
    (
        'DE_HEALTH_INSURANCE',
        (
            (0.3, r"\b[A-Z]\d{9}\b"),
        ),
        ("krankenversicherungsnummer", "krankenversichertennummer", "versichertennummer", "kvnr", "krankenkasse", "krankenversicherung", "gesundheitskarte", "egk", "elektronische gesundheitskarte", "gkv", "gesetzliche krankenversicherung", "krankenversicherungsausweis", "versichertenausweis", "versichertenkarte", "aok", "tkk", "barmer", "dak",),
    ),
    (
        'DE_ID_CARD',
        (
            (0.4, r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[CFGHJKLMNPRTVWXYZ0-9]\b"),
            (0.5, r"\bT\d{8}\b"),
            (0.15, r"\b[A-Z][A-Z0-9]{8}\b"),
        ),
        ("personalausweis", "ausweis", "personalausweisnummer", "ausweisnummer", "ausweisdokument", "dokumentennummer", "seriennummer", "npa", "neuer personalausweis", "personalausweisgesetz", "pauwsg", "bundespersonalausweis", "identity card", "national id",),
    ),
    (
        'DE_KFZ',
        (
            (0.3, r"(?<![\w-])[A-ZÄÖÜ]{1,3}\s[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)"),
            (0.3, r"(?<![\w-])[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}-\d{1,4}[EH]?(?!\w)"),
            (0.3, r"(?<![\w-])[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)"),
            (0.2, r"(?<![\w-])[A-Z]{1,3}\s[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)"),
            (0.2, r"(?<![\w-])[A-Z]{1,3}-[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)"),
        ),
        ("kennzeichen", "kfz-kennzeichen", "kraftfahrzeugkennzeichen", "nummernschild", "fahrzeugkennzeichen", "zulassung", "kfz", "fahrzeug", "auto", "pkw", "lkw", "fahrzeugschein", "fahrzeugbrief", "zulassungsbescheinigung", "amtliches kennzeichen",),
    ),
    (
        'DE_LANR',
        (
            (0.3, r"\b\d{9}\b"),
        ),
        ("arztnummer", "lanr", "lebenslange arztnummer", "arzt-nr", "arzt nr", "arzt-nummer", "vertragsarzt", "kassenarzt", "niedergelassener arzt", "kbv", "kassenärztliche vereinigung", "kv-nummer", "rezept", "verschreibung", "behandelnder arzt", "hausarzt", "facharzt",),
    ),
    (
        'DE_PASSPORT',
        (
            (0.4, r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[0-9]\b"),
            (0.2, r"\b[A-Z][A-Z0-9]{7}[0-9]\b"),
        ),
        ("reisepass", "pass", "passnummer", "reisepassnummer", "passport", "passport number", "pass-nr", "dokumentennummer", "bundesrepublik deutschland", "ausweisdokument", "mrz",),
    ),
    (
        'DE_PLZ',
        (
            (0.05, r"\b(?!01000\b|99999\b)(0[1-9]\d{3}|[1-9]\d{4})\b"),
        ),
        ("plz", "postleitzahl", "postanschrift", "adresse", "wohnort", "ort", "wohnanschrift", "lieferadresse", "rechnungsadresse", "straße", "strasse", "hausnummer", "postfach", "bundesland", "gemeinde", "stadt", "dorf",),
    ),
    (
        'DE_SOCIAL_SECURITY',
        (
            (0.5, r"\b\d{2}(0[1-9]|[12]\d|3[01]|5[1-9]|[67]\d|8[01])(0[1-9]|1[0-2])\d{2}[A-Z]\d{2}[0-9]\b"),
            (0.3, r"\b\d{8}[A-Z]\d{3}\b"),
        ),
        ("rentenversicherungsnummer", "sozialversicherungsnummer", "versicherungsnummer", "rvnr", "svnr", "sv-nummer", "rente", "rentenversicherung", "deutsche rentenversicherung", "drv", "sozialversicherung", "sozialversicherungsausweis", "rentenausweis",),
    ),
    (
        'DE_TAX_ID',
        (
            (0.5, r"\b[1-9]\d{10}\b"),
        ),
        ("steueridentifikationsnummer", "steuer-id", "steuerid", "steuerliche identifikationsnummer", "steuerliche identifikation", "persönliche identifikationsnummer", "steuer identifikation", "idnr", "steuer-idnr", "steuernummer", "bzst",),
    ),
    (
        'DE_TAX_NUMBER',
        (
            (0.5, r"\b(0[1-9]|1[0-6])\d{11}\b"),
            (0.4, r"(?<!\w)\d{3}/\d{3}/\d{5}(?!\w)"),
            (0.2, r"(?<!\w)\d{2,3}/\d{3,4}/\d{4,5}(?!\w)"),
        ),
        ("steuernummer", "steuer-nr", "steuer nr", "st.-nr", "st-nr", "finanzamt", "umsatzsteuer", "einkommensteuer", "körperschaftsteuer", "gewerbesteuer", "steuerveranlagung", "steuerbescheid",),
    ),
    (
        'DE_VAT_ID',
        (
            (0.5, r"\bDE\d{9}\b"),
        ),
        ("umsatzsteuer-identifikationsnummer", "umsatzsteueridentifikationsnummer", "ust-idnr", "ust-id", "ustidnr", "umsatzsteuer-id", "mehrwertsteuer", "vat", "vat-id", "vat id", "steueridentifikation", "bzst", "bundeszentralamt für steuern", "finanzamt", "invoice", "rechnung",),
    ),
    (
        'IN_AADHAAR',
        (
            (0.01, r"\b[0-9]{12}\b"),
            (0.01, r"\b[0-9]{4}[- :][0-9]{4}[- :][0-9]{4}\b"),
        ),
        ("aadhaar", "uidai",),
    ),
    (
        'IN_GSTIN',
        (
            (0.8, r"\b((?:0[1-9]|[1-3][0-7])[A-Za-z0-9]{10}[A-Za-z0-9]{1}Z[A-Za-z0-9]{1})\b"),
            (0.4, r"\b((?:0[1-9]|[1-3][0-7])[A-Za-z0-9]{11}Z[A-Za-z0-9]{1})\b"),
            (0.1, r"\b([0-9]{2}[A-Za-z0-9]{11}Z[A-Za-z0-9]{1})\b"),
        ),
        ("gstin", "gst", "goods and services tax", "tax identification", "gst number", "gst registration",),
    ),
    (
        'IN_PAN',
        (
            (0.5, r"\b([A-Za-z]{3}[AaBbCcFfGgHhJjLlPpTt]{1}[A-Za-z]{1}[0-9]{4}[A-Za-z]{1})\b"),
            (0.1, r"\b([A-Za-z]{5}[0-9]{4}[A-Za-z]{1})\b"),
            (0.01, r"\b((?=.*?[a-zA-Z])(?=.*?[0-9]{4})[\w@#$%^?~-]{10})\b"),
        ),
        ("permanent account number", "pan",),
    ),
    (
        'IN_PASSPORT',
        (
            (0.1, r"\b[A-Z][1-9]\d\s?\d{4}[1-9]\b"),
        ),
        ("passport", "indian passport", "passport number",),
    ),
    (
        'IN_VEHICLE_REGISTRATION',
        (
            (0.01, r"\b[A-Z]{1}(?!0000)[0-9]{4}\b"),
            (0.01, r"\b[A-Z]{2}(?!0000)\d{4}\b"),
            (0.01, r"\b(I)(?!00000)\d{5}\b"),
            (0.2, r"\b[A-Z]{3}(?!0000)\d{4}\b"),
            (0.4, r"\b\d{1,3}(CD|CC|UN)[1-9]{1}[0-9]{1,3}\b"),
            (0.5, r"\b[A-Z]{2}\d{1}[A-Z]{1,3}(?!0000)\d{4}\b"),
            (0.5, r"\b[A-Z]{2}\d{2}[A-Z]{1,2}(?!0000)\d{4}\b"),
            (0.85, r"\b[2-9]{1}[1-9]{1}(BH)(?!0000)\d{4}[A-HJ-NP-Z]{2}\b"),
            (0.85, r"\b(?!00)\d{2}(A|B|C|D|E|F|H|K|P|R|X)\d{6}[A-Z]{1}\b"),
        ),
        ("RTO", "vehicle", "plate", "registration",),
    ),
    (
        'IN_VOTER',
        (
            (0.4, r"\b([A-Za-z]{1}[ABCDGHJKMNPRSYabcdghjkmnprsy]{1}[A-Za-z]{1}([0-9]){7})\b"),
            (0.3, r"\b([A-Za-z]){3}([0-9]){7}\b"),
        ),
        ("voter", "epic", "elector photo identity card",),
    ),
    (
        'IT_DRIVER_LICENSE',
        (
            (0.2, r"\b(?i)(([A-Z]{2}\d{7}[A-Z])|(U1[BCDEFGHLJKMNPRSTUWYXZ0-9]{7}[A-Z]))\b"),
        ),
        ("patente", "patente di guida", "licenza", "licenza di guida",),
    ),
    (
        'IT_FISCAL_CODE',
        (
            (0.3, r"(?i)((?:[A-Z][AEIOU][AEIOUX]|[AEIOU]X{2}|[B-DF-HJ-NP-TV-Z]{2}[A-Z]){2}(?:[\dLMNP-V]{2}(?:[A-EHLMPR-T](?:[04LQ][1-9MNP-V]|[15MR][\dLMNP-V]|[26NS][0-8LMNP-U])|[DHPS][37PT][0L]|[ACELMRT][37PT][01LM]|[AC-EHLMPR-T][26NS][9V])|(?:[02468LNQSU][048LQU]|[13579MPRTV][26NS])B[26NS][9V])(?:[A-MZ][1-9MNP-V][\dLMNP-V]{2}|[A-M][0L](?:[1-9MNP-V][\dLMNP-V]|[0L][1-9MNP-V]))[A-Z])"),
        ),
        ("codice fiscale", "cf",),
    ),
    (
        'IT_IDENTITY_CARD',
        (
            (0.01, r"(?i)\b[A-Z]{2}\s?\d{7}\b"),
            (0.01, r"(?i)\b\d{7}[A-Z]{2}\b"),
            (0.01, r"(?i)\b[A-Z]{2}\d{5}[A-Z]{2}\b"),
        ),
        ("carta", "identità", "elettronica", "cie", "documento", "riconoscimento", "espatrio",),
    ),
    (
        'IT_PASSPORT',
        (
            (0.01, r"(?i)\b[A-Z]{2}\d{7}\b"),
        ),
        ("passaporto", "elettronico", "italiano", "viaggio", "viaggiare", "estero", "documento", "dogana",),
    ),
    (
        'IT_VAT_CODE',
        (
            (0.1, r"\b([0-9][ _]?){11}\b"),
        ),
        ("piva", "partita iva", "pi",),
    ),
    (
        'KR_BRN',
        (
            (0.1, r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)"),
            (0.05, r"(?<!\d)\d{10}(?!\d)"),
        ),
        ("사업자등록번호", "사업자번호", "사업자", "BRN", "Business Registration Number", "Korean BRN", "business number", "tax registration number",),
    ),
    (
        'KR_DRIVER_LICENSE',
        (
            (0.05, r"(?<!\d)(\d{2})[- ]?(\d{2})[- ]?(\d{6})[- ]?(\d{2})(?!\d)"),
        ),
        ("운전면허", "운전면허번호", "면허번호", "Korean driver license", "Korean driver's license",),
    ),
    (
        'KR_FRN',
        (
            (0.5, r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(-?)[5-8]\d{6}(?!\d)"),
        ),
        ("외국인등록번호", "Korean FRN", "FRN", "Foreigner Registration Number", "Korean Foreigner Registration Number", "외국인번호",),
    ),
    (
        'KR_PASSPORT',
        (
            (0.1, r"(?<![A-Z0-9a-z])[MmSsRrOoDd]\d{3}[A-Za-z]\d{4}(?![0-9])"),
            (0.05, r"(?<![A-Z0-9a-z])[MmSsRrOoDd]\d{8}(?![0-9])"),
        ),
        ("Korean passport", "Korean passport number", "대한민국 여권", "여권", "passport", "passport number",),
    ),
    (
        'KR_RRN',
        (
            (0.5, r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(-?)[1-4]\d{6}(?!\d)"),
        ),
        ("Korean RRN", "Korean Resident Registration Number", "Resident Registration Number", "RRN", "rrn", "rrn#",),
    ),
    (
        'NG_NIN',
        (
            (0.01, r"\b\d{11}\b"),
        ),
        ("nin", "national identification number", "national identity number", "nimc", "national identity", "nigeria id", "nigerian identification",),
    ),
    (
        'NG_VEHICLE_REGISTRATION',
        (
            (0.5, r"\b[A-Z]{3}[- ]?\d{3}[A-Z]{2}\b"),
        ),
        ("plate number", "vehicle registration", "license plate", "number plate", "plate", "vehicle", "registration",),
    ),
    (
        'PL_PESEL',
        (
            (0.4, r"[0-9]{2}([02468][1-9]|[13579][012])(0[1-9]|1[0-9]|2[0-9]|3[01])[0-9]{5}"),
        ),
        ("PESEL",),
    ),
    (
        'SG_NRIC_FIN',
        (
            (0.3, r"(?i)(\b[A-Z][0-9]{7}[A-Z]\b)"),
            (0.5, r"(?i)(\b[STFGM][0-9]{7}[A-Z]\b)"),
        ),
        ("fin", "fin#", "nric", "nric#",),
    ),
    (
        'SG_UEN',
        (
            (0.3, r"\b\d{8}[A-Z]\b|\b\d{9}[A-Z]\b|\b(T|S)\d{2}[A-Z]{2}\d{4}[A-Z]\b"),
        ),
        ("uen", "unique entity number", "business registration", "ACRA",),
    ),
    (
        'ES_NIE',
        (
            (0.5, r"\b[X-Z]?[0-9]?[0-9]{7}[-]?[A-Z]\b"),
        ),
        ("número de identificación de extranjero", "NIE",),
    ),
    (
        'ES_NIF',
        (
            (0.5, r"\b[0-9]?[0-9]{7}[-]?[A-Z]\b"),
        ),
        ("documento nacional de identidad", "DNI", "NIF", "identificación",),
    ),
    (
        'SE_ORGANISATIONSNUMMER',
        (
            (0.6, r"\b\d{6}[-]?\d{4}\b"),
            (0.2, r"\d{6}[-]?\d{4}"),
        ),
        ("organisationsnummer", "orgnr", "org nr", "företagsnummer",),
    ),
    (
        'SE_PERSONNUMMER',
        (
            (0.5, r"\b(\d{6,8})([-+]?)\d{4}\b"),
            (0.1, r"(\d{6,8})([-+]?)\d{4}"),
        ),
        ("personnummer", "svenskt personnummer", "svensk id", "ssn", "personal identity number", "samordningsnummer",),
    ),
    (
        'TH_TNIN',
        (
            (0.5, r"\b[1-9](?:[134][0-9]|[25][0134567]|[67][01234567]|[89][0123456])\d{10}\b"),
        ),
        ("Thai National ID", "Thai ID Number", "TNIN", "เลขประจำตัวประชาชน", "เลขบัตรประชาชน", "รหัสปชช",),
    ),
    (
        'UK_NHS',
        (
            (0.5, r"\b([0-9]{3})[- ]?([0-9]{3})[- ]?([0-9]{4})\b"),
        ),
        ("national health service", "nhs", "health services authority", "health authority",),
    ),
    (
        'UK_NINO',
        (
            (0.5, r"\b(?!bg|gb|nk|kn|nt|tn|zz|BG|GB|NK|KN|NT|TN|ZZ) ?([a-ceghj-pr-tw-zA-CEGHJ-PR-TW-Z]{1}[a-ceghj-npr-tw-zA-CEGHJ-NPR-TW-Z]{1}) ?([0-9]{2}) ?([0-9]{2}) ?([0-9]{2}) ?([a-dA-D{1}])\b"),
        ),
        ("national insurance", "ni number", "nino",),
    ),
    (
        'UK_PASSPORT',
        (
            (0.1, r"\b[A-Z]{2}\d{7}\b"),
        ),
        ("passport", "passport number", "travel document", "uk passport", "british passport", "her majesty", "his majesty", "hm passport", "hmpo",),
    ),
    (
        'UK_POSTCODE',
        (
            (0.1, r"\b(GIR\s?0AA|[A-PR-UWYZ][0-9][ABCDEFGHJKPSTUW]?\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][0-9]{2}\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y][0-9][ABEHMNPRVWXY]?\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y][0-9]{2}\s?[0-9][ABD-HJLNP-UW-Z]{2})\b"),
        ),
        ("postcode", "post code", "postal code", "zip", "address", "delivery", "mailing", "shipping", "correspondence",),
    ),
    (
        'UK_VEHICLE_REGISTRATION',
        (
            (0.3, r"\b[A-HJ-PR-Y][A-HJ-PR-Y](?:0[1-9]|[1-7][0-9])[- ]?[A-HJ-PR-Z]{3}\b"),
            (0.2, r"\b[A-HJ-NPR-TV-Y]\d{1,3}[- ]?[A-HJ-PR-Y][A-HJ-PR-Z]{2}\b"),
            (0.15, r"\b[A-HJ-PR-Z]{3}[- ]?\d{1,3}[- ]?[A-HJ-NPR-TV-Y]\b"),
        ),
        ("vehicle", "registration", "number plate", "licence plate", "license plate", "reg", "vrn", "dvla", "v5c", "logbook", "mot", "car", "insured vehicle",),
    ),
    (
        'ABA_ROUTING_NUMBER',
        (
            (0.05, r"\b[0123678]\d{8}\b"),
            (0.3, r"\b[0123678]\d{3}-\d{4}-\d\b"),
        ),
        ("aba", "routing", "abarouting", "association", "bankrouting",),
    ),
    (
        'MEDICAL_LICENSE',
        (
            (0.4, r"[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]{1}[a-zA-Z]{1}\d{7}|[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]{1}9\d{7}"),
        ),
        ("medical", "certificate", "DEA",),
    ),
    (
        'US_BANK_NUMBER',
        (
            (0.05, r"\b[0-9]{8,17}\b"),
        ),
        ("check", "account", "account#", "acct", "bank", "save", "debit",),
    ),
    (
        'US_DRIVER_LICENSE',
        (
            (0.3, r"\b([A-Z][0-9]{3,6}|[A-Z][0-9]{5,9}|[A-Z][0-9]{6,8}|[A-Z][0-9]{4,8}|[A-Z][0-9]{9,11}|[A-Z]{1,2}[0-9]{5,6}|H[0-9]{8}|V[0-9]{6}|X[0-9]{8}|A-Z]{2}[0-9]{2,5}|[A-Z]{2}[0-9]{3,7}|[0-9]{2}[A-Z]{3}[0-9]{5,6}|[A-Z][0-9]{13,14}|[A-Z][0-9]{18}|[A-Z][0-9]{6}R|[A-Z][0-9]{9}|[A-Z][0-9]{1,12}|[0-9]{9}[A-Z]|[A-Z]{2}[0-9]{6}[A-Z]|[0-9]{8}[A-Z]{2}|[0-9]{3}[A-Z]{2}[0-9]{4}|[A-Z][0-9][A-Z][0-9][A-Z]|[0-9]{7,8}[A-Z])\b"),
            (0.01, r"\b([0-9]{6,14}|[0-9]{16})\b"),
        ),
        ("driver", "license", "permit", "lic", "identification", "dls", "cdls", "lic#", "driving",),
    ),
    (
        'US_ITIN',
        (
            (0.05, r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))\d{4}\b|\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))[- ]\d{4}\b"),
            (0.3, r"\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))\d{4}\b"),
            (0.5, r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))[- ]\d{4}\b"),
        ),
        ("individual", "taxpayer", "itin", "tax", "payer", "taxid", "tin",),
    ),
    (
        'US_NPI',
        (
            (0.1, r"\b[12]\d{9}\b"),
            (0.4, r"\b[12]\d{3}[ -]\d{3}[ -]\d{3}\b"),
        ),
        ("npi", "national provider", "provider", "npi number", "provider id", "provider identifier", "taxonomy",),
    ),
    (
        'US_PASSPORT',
        (
            (0.05, r"(\b[0-9]{9}\b)"),
            (0.1, r"(\b[A-Z][0-9]{8}\b)"),
        ),
        ("us", "united", "states", "passport", "passport#", "travel", "document",),
    ),
    (
        'US_SSN',
        (
            (0.05, r"\b([0-9]{5})-([0-9]{4})\b"),
            (0.05, r"\b([0-9]{3})-([0-9]{6})\b"),
            (0.05, r"\b(([0-9]{3})-([0-9]{2})-([0-9]{4}))\b"),
            (0.05, r"\b[0-9]{9}\b"),
            (0.5, r"\b([0-9]{3})[- .]([0-9]{2})[- .]([0-9]{4})\b"),
        ),
        ("social", "security", "ssn", "ssns", "ssid",),
    ),
    (
        'CREDIT_CARD',
        (
            (0.3, r"\b(?!1\d{12}(?!\d))((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b"),
        ),
        ("credit", "card", "visa", "mastercard", "cc ", "amex", "discover", "jcb", "diners", "maestro", "instapayment",),
    ),
    (
        'CRYPTO',
        (
            (0.5, r"(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}"),
        ),
        ("wallet", "btc", "bitcoin", "crypto",),
    ),
    (
        'DATE_TIME',
        (
            (0.8, r"\b(\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d:[0-5]\d\.\d+([+-][0-2]\d:[0-5]\d|Z))|(\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d:[0-5]\d([+-][0-2]\d:[0-5]\d|Z))|(\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d([+-][0-2]\d:[0-5]\d|Z))\b"),
            (0.6, r"\b(([1-9]|0[1-9]|1[0-2])/([1-9]|0[1-9]|[1-2][0-9]|3[0-1])/(\d{4}|\d{2}))\b"),
            (0.6, r"\b(([1-9]|0[1-9]|[1-2][0-9]|3[0-1])/([1-9]|0[1-9]|1[0-2])/(\d{4}|\d{2}))\b"),
            (0.6, r"\b(\d{4}/([1-9]|0[1-9]|1[0-2])/([1-9]|0[1-9]|[1-2][0-9]|3[0-1]))\b"),
            (0.6, r"\b(([1-9]|0[1-9]|1[0-2])-([1-9]|0[1-9]|[1-2][0-9]|3[0-1])-\d{4})\b"),
            (0.6, r"\b(([1-9]|0[1-9]|[1-2][0-9]|3[0-1])-([1-9]|0[1-9]|1[0-2])-\d{4})\b"),
            (0.6, r"\b(\d{4}-([1-9]|0[1-9]|1[0-2])-([1-9]|0[1-9]|[1-2][0-9]|3[0-1]))\b"),
            (0.6, r"\b(([1-9]|0[1-9]|[1-2][0-9]|3[0-1])\.([1-9]|0[1-9]|1[0-2])\.(\d{4}|\d{2}))\b"),
            (0.6, r"\b(([1-9]|0[1-9]|[1-2][0-9]|3[0-1])-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-(\d{4}|\d{2}))\b"),
            (0.6, r"\b((JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-(\d{4}|\d{2}))\b"),
            (0.6, r"\b(([1-9]|0[1-9]|[1-2][0-9]|3[0-1])-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC))\b"),
            (0.2, r"\b(([1-9]|0[1-9]|1[0-2])/\d{4})\b"),
            (0.1, r"\b(([1-9]|0[1-9]|1[0-2])/\d{2})\b"),
        ),
        ("date", "birthday",),
    ),
    (
        'EMAIL_ADDRESS',
        (
            (0.5, r"\b((([!#$%&'*+\-/=?^_`{|}~\w])|([!#$%&'*+\-/=?^_`{|}~\w][!#$%&'*+\-/=?^_`{|}~\.\w]{0,}[!#$%&'*+\-/=?^_`{|}~\w]))[@]\w+([-.]\w+)*\.\w+([-.]\w+)*)\b"),
        ),
        ("email",),
    ),
    (
        'IBAN_CODE',
        (
            (0.5, r"(?<![A-Z0-9])([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,6})((?:[ -]?[A-Z0-9]{4})?)((?:[ -]?[A-Z0-9]{1,3})?)(?![A-Z0-9])"),
        ),
        ("iban", "bank", "transaction",),
    ),
    (
        'IP_ADDRESS',
        (
            (0.6, r"(?<![\w:])::(?:ffff(?::0{1,4})?:)?(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:/(?:12[0-8]|1[01]\d|[1-9]?\d))?\b"),
            (0.6, r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){1,5}:(?:[0-9A-Fa-f]{1,4}:){0,4}|(?:[0-9A-Fa-f]{1,4}:){6})(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:/(?:12[0-8]|1[01]\d|[1-9]?\d))?\b"),
            (0.6, r"\b(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:/(?:[0-2]?\d|3[0-2]))?\b"),
            (0.6, r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,5}(?::[0-9A-Fa-f]{1,4}){1,2}|(?:[0-9A-Fa-f]{1,4}:){1,4}(?::[0-9A-Fa-f]{1,4}){1,3}|(?:[0-9A-Fa-f]{1,4}:){1,3}(?::[0-9A-Fa-f]{1,4}){1,4}|(?:[0-9A-Fa-f]{1,4}:){1,2}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?::[0-9A-Fa-f]{1,4}){1,6})(?:%[0-9a-zA-Z]+)?(?:/(?:12[0-8]|1[01]\d|[1-9]?\d))?(?![\w:]|\.\d)"),
            (0.1, r"(?<![\w:])::(?:/(?:12[0-8]|1[01]\d|[1-9]?\d))?(?![\w:])"),
        ),
        ("ip", "ipv4", "ipv6",),
    ),
    (
        'MAC_ADDRESS',
        (
            (0.6, r"\b[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}\b"),
            (0.6, r"\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b"),
        ),
        ("mac", "mac address", "hardware address", "physical address", "ethernet",),
    ),
)

#: A link with a scheme, and one that starts like a host name; both end before white space and closing signs.
RECOGNIZERS += (
    ("URL", ((0.6, r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>)]*)?"), (0.5, r"\bwww\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s\"'<>)]*)?")), ("url", "website", "link")),
    ("PHONE_NUMBER", ((0.4, r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])"),), ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call")),
)
