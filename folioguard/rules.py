"""Rule tables.  Fixed values: labels, patterns, weights, slots and wording.

Every rule table can be replaced by the caller; the functions take them as
arguments with these as defaults.
"""

from __future__ import annotations

OTHER = "Sonstiges"

#: Document types with (label, pattern, weight), in rule order.
CLASSIFICATION = [
    ("Anschreiben", [
        ("Bewerbung um die Wohnung", r"\bBEWERBUNG (?:UM|F[UÜ]R) (?:DIE )?WOHNUNG\b", 5),
        ("Sehr geehrte", r"\bSEHR GEEHRTE\b", 2),
        ("Mietinteresse", r"\bMIETINTERESSE\b", 2),
        ("Besichtigung", r"\bBESICHTIGUNG\b", 1),
    ]),
    ("Gehaltsabrechnung", [
        ("Gehalts-/Lohnabrechnung", r"\b(?:GEHALTS|LOHN|ENTGELT)ABRECHNUNG\b", 4),
        ("Brutto", r"\bBRUTTO(?:BEZUG|ENTGELT)?\b", 2),
        ("Netto", r"\bNETTO(?:BEZUG|ENTGELT)?\b", 2),
        ("Lohnsteuer", r"\bLOHNSTEUER\b", 2),
        ("Sozialversicherung", r"\bSOZIALVERSICHERUNG\b", 1),
    ]),
    ("SCHUFA-Auskunft", [
        ("SCHUFA", r"\bSCHUFA\b", 5),
        ("Bonitätsauskunft", r"\bBONIT[AÄ]TSAUSKUNFT\b", 3),
        ("Basisscore", r"\bBASISSCORE\b", 2),
        ("Bonitätsinformationen", r"\bBONIT[AÄ]TSINFORMATIONEN?\b", 2),
    ]),
    ("Mieterselbstauskunft", [
        ("Mieterselbstauskunft", r"\bMIETERSELBSTAUSKUNFT\b", 6),
        ("Mietinteressent", r"\bMIETINTERESSENT(?:IN)?\b", 2),
        ("Einziehende Personen", r"\bEINZIEHENDE PERSONEN\b", 2),
        ("Mietverhältnis", r"\bMIETVERH[AÄ]LTNIS\b", 1),
    ]),
    ("Identitätsnachweis", [
        ("Personalausweis", r"\bPERS[O0]NAL\s*[- ]?\s*AUSWEIS\b", 5),
        ("Reisepass/Passport", r"\b(?:REISEPASS|PASSPORT)\b", 5),
        ("Identity Card", r"\bIDENTITY\s*CARD\b", 4),
        ("Dokumentennummer", r"\b(?:DOKUMENT(?:EN)?|AUSWEIS)\s*(?:NUMMER|NR)\b|\bDOCUMENT\s*(?:NUMBER|NO)\b", 2),
        ("Bundesrepublik Deutschland", r"\bBUNDESREPUBLIK\s+DEUTSCHLAND\b", 2),
        ("Staatsangehörigkeit", r"\bSTAATSANGEH[OÖ]RIGKEIT\b|\bNATIONALITY\b", 1),
        ("Geburtsdatum", r"\bGEBURTSDATUM\b|\bDATE\s+OF\s+BIRTH\b", 1),
        ("MRZ-Ausweiszeile", r"\bI[D0]D\s*<+", 3),
    ]),
    ("Arbeitsvertrag", [
        ("Arbeitsvertrag", r"\bARBEITSVERTRAG\b", 6),
        ("Arbeitgeber", r"\bARBEITGEBER\b", 2),
        ("Arbeitnehmer", r"\bARBEITNEHMER(?:IN)?\b", 2),
        ("Probezeit", r"\bPROBEZEIT\b", 1),
        ("Vergütung", r"\bVERG[UÜ]TUNG\b", 1),
    ]),
    ("Kontoauszug", [
        ("Kontoauszug", r"\bKONTOAUSZUG\b", 6),
        ("Kontostand", r"\bKONTOSTAND\b", 2),
        ("Buchungstag", r"\bBUCHUNGSTAG\b", 2),
        ("Wertstellung", r"\bWERTSTELLUNG\b", 2),
        ("IBAN", r"\bIBAN\b", 1),
    ]),
]
LEAST_SCORE, SURE = 3, 65

#: Fixed values: (label, action, level, title, reason).
RECOMMENDATIONS = [
    ("Steuer-ID", "redact", "high", "Schwärzen empfohlen", "Die Steuer-ID ist für die Prüfung einer Wohnungsbewerbung normalerweise nicht erforderlich."),
    ("Sozialversicherungsnummer", "redact", "high", "Schwärzen empfohlen", "Die Sozialversicherungsnummer ist kein üblicher Nachweis für Einkommen oder Bonität."),
    ("Ausweisnummer", "redact", "high", "Schwärzen empfohlen", "Zur Identitätsprüfung genügt regelmäßig das Vorzeigen; eine sichtbare Dokumentnummer ist meist nicht nötig."),
    ("Maschinenlesbare Zone (MRZ)", "redact", "high", "Schwärzen empfohlen", "Die maschinenlesbare Zone enthält gebündelte Identitätsdaten und sollte bei einer Wohnungsbewerbung nicht sichtbar mitgesendet werden."),
    ("IBAN", "redact", "medium", "Schwärzen empfohlen", "Für die Wohnungsbewerbung ist die IBAN meist nicht erforderlich und wird typischerweise erst später benötigt."),
    ("QR-Code / Barcode", "redact", "high", "Schwärzen empfohlen", "QR-Codes und Barcodes können interne Referenzen oder weitere maschinenlesbare Daten enthalten, die für die Bewerbung meist nicht benötigt werden."),
    ("Unterschrift", "review", "medium", "Sichtbarkeit prüfen", "Eine Unterschrift kann missbraucht werden. Der Bereich wird zur Kontrolle markiert, aber nicht ungefragt geschwärzt."),
]
DISCLAIMER = "Empfehlung für eine Wohnungsbewerbung – bitte vor dem Export selbst prüfen."
COST = {"high": 22, "medium": 12}
MRZ, ID_NUMBER, SIGNATURE = "Maschinenlesbare Zone (MRZ)", "Ausweisnummer", "Unterschrift"

#: The required slots in order, the one that takes several
#: documents, and the slot of each document type that has one.
SLOTS = ["Anschreiben", "Mieterselbstauskunft", "Gehaltsnachweise", "SCHUFA-Auskunft", "Ausweiskopie"]
MULTI = ["Gehaltsnachweise"]
TYPE_TO_SLOT = {
    "Anschreiben": "Anschreiben",
    "Mieterselbstauskunft": "Mieterselbstauskunft",
    "Gehaltsabrechnung": "Gehaltsnachweise",
    "SCHUFA-Auskunft": "SCHUFA-Auskunft",
    "Identitätsnachweis": "Ausweiskopie",
}

#: Context patterns over compact upper-case lines.
TAX_CONTEXT = "STEUER(?:LICHE)?(?:IDENTIFIKATIONSNUMMER|ID)|IDENTIFIKATIONSNUMMER|IDNR|STEUERLICHEIDNR|TIN"
SOCIAL_CONTEXT = "SOZIALVERSICHERUNG|VERSICHERUNGSNUMMER|SVNUMMER|RENTENVERSICHERUNG"
ID_LABEL = "AUSWEIS(?:NUMMER|NR)|DOKUMENT(?:EN)?(?:NUMMER|NR)|DOCUMENT(?:NUMBER|NO|NR)"
ID_LABEL_TOKEN = "AUSWEIS(?:NUMMER|NR)|DOKUMENT(?:EN)?(?:NUMMER|NR)"
