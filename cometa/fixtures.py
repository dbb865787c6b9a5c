"""Golden audit cases and hand-traced edge cases, shared by tests and docs."""

# ---------------------------------------------------------------------------
# The 31 published (note, comment, expected label) cases.
# ---------------------------------------------------------------------------
GOLDEN_CASES = [
    ("B111", "12345 67890", "C"),
    ("B111", "", "SC"),
    ("B111", "12345", "FL"),
    ("E101", "M123456", "C"),
    ("E101", "123456", "CI"),
    ("C111", "Rua das Flores", "C"),
    ("C111", "ABC", "C"),
    ("T161", "01", "C"),
    ("T161", "01 123", "CFP"),
    ("T181", "03 12345", "CFP"),
    ("R111", "0312345", "CFP"),
    ("B111", "103123456", "C"),
    ("P111", "12345 6789 SELO", "C"),
    ("L131", "SELO", "C"),
    ("P111", "SELO", "NI"),
    ("T181", "103 15040.", "UCE"),
    ("P111", "cliente nao estava", "NI"),
    ("T181", "103 03221", "C"),
    ("T181", "55 034429", "C"),
    ("R111", "MV08207 3181313071", "C"),
    ("P111", "5260328370 03 00000", "C"),
    ("P111", "3203600940 3 012051 24 001929", "C"),
    ("P111", "3242491466 03 114 24 53", "C"),
    ("P111", "6252237400 03 999999 103 999999", "C"),
    ("P111", "5257431454 03 140 103 0", "C"),
    ("R111", "3010214262 3243797216 103 22851", "C"),
    ("P111", "6252079651 03 3 103 0", "C"),
    ("T181", "55 41205 T111", "C"),
    ("P111", "S202184113 T181 103 24 03 00312", "C"),
    ("E101", "s138628", "C"),
    ("E101", "s138629", "C"),
]

# Worked examples from the rule documentation.
PROSE_CASES = [
    ("T181", "103 15040", "C"),
    ("P111", "3243946009 131", "C"),
    ("L131", "", "C"),
    ("B111", "", "SC"),
]

# Edge cases traced by hand from the rule definitions (None = NULL label).
EDGE_CASES = [
    ("L121", "anything", None),
    ("L121", None, None),
    ("T161", None, "C"),
    ("T171", "", "C"),
    ("P191", "   ", "C"),
    ("L131", "\t", "C"),
    ("Z999", "", "SC"),
    ("Z999", "abc", "C"),
    ("P111", "12_34", "C"),
    ("P111", "à 12345 678", "C"),
    ("P111", "á 12345 678", "CFP"),
    ("P111", "12345   678", "EE"),
    ("P111", "   12345 678", "C"),
    ("P111", "12\t\t\t34", "C"),
    ("P111", "12345 T181", "C"),
    ("P111", "T181", "FL"),
    ("P111", "1 2 3 4 5 6 7 8", "C"),
    ("P111", "1 2 3 4 5 6 7 8 9", "CFP"),
    ("T171", "3010214262 55", "C"),
    ("T171", "3222 55", "NI"),
    ("T171", "SELO", "C"),
    ("T171", "cliente", "NI"),
    ("E101", "poste M123456", "CFP"),
    ("E101", "M123456X5", "C"),
    ("E101", "M1234567", "C"),
    ("E101", "M12345", "CI"),
    ("E101", "X1", "C"),
    ("E101", "A123456", "CI"),
    ("E101", "SELO", "NI"),
    ("R111", "MV08207 NR DI", "CFP"),
    ("R111", "MV08207 SELO", "C"),
    ("R111", "12345", "C"),
    ("R111", "5 03 7", "CFP"),
    ("T161", "S", "C"),
    ("T161", "01 S", "CFP"),
    ("T161", "1", "CFP"),
    ("T181", "12", "CI"),
    ("T181", "1234", "CI"),
    ("T181", "12345", "FL"),
    ("T181", "55", "FL"),
    ("T181", "5512", "C"),
    ("T181", "1031234567", "FL"),
    ("T181", "SELO", "NI"),
    ("T181", "A03", "CI"),
    ("T181", "03.", "UCE"),
    ("C111", "SELO", "C"),
    (None, "", "SC"),
    (None, "abc", "C"),
    (" B111 ", " 12345 67890 ", "C"),
    ("B111", " 12345 67890 ", "C"),
    ("B111", "12345\x1c", "FL"),
    ("P111", "١٢٣٤٥ 678", "C"),
    ("R111", "123 ABC", "CFP"),
    ("R111", "1 2 3 4 5 6 7 8 9", "CFP"),
    ("R111", "MV1 S", "C"),
]
