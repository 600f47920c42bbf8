"""Expected rows of the queries over small texts of our own, as SQL of literal rows."""

from __future__ import annotations

EXPECTED: dict[str, str] = {}

EXPECTED["parse_dates"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "i", CAST(c2 AS VARCHAR) AS "line", CAST(c3 AS DATE) AS "start", CAST(c4 AS DATE) AS "end", CAST(c5 AS BOOLEAN) AS "corrected"
FROM (VALUES
('V01-P0001', 0, 'APRIL 28, 1619 3', '1619-04-28', '1619-04-28', false),
('V01-P0001', 1, 'A COURT HELD FOR VIRGINIA THE 28 OF APRIL 1619', '1619-04-28', '1619-04-28', false),
('V01-P0001', 2, 'PRESENT', NULL, NULL, NULL),
('V01-P0001', 3, 'Sir Edwin Sandys.', NULL, NULL, NULL),
('V01-P0001', 4, 'mr Iohn Ferrar. mr Wrote', NULL, NULL, NULL),
('V01-P0001', 5, 'Lord Sheffield', NULL, NULL, NULL),
('V01-P0001', 6, '', NULL, NULL, NULL),
('V01-P0001', 7, 'The court was moved to consider of the land that was graunted last yeare to them.', NULL, NULL, NULL),
('V01-P0002', 0, 'MAY 1619 4', '1619-05-01', '1619-05-31', false),
('V01-P0002', 1, 'It was ordered that Captaine Argall, late Governor of Virginia, should come home. Sir Thomas Smith went to Virginia, and Bermuda.', NULL, NULL, NULL),
('V01-P0002', 2, 'Captain Smith his wife Mary Smith was there.', NULL, NULL, NULL),
('V01-P0003', 0, 'no date here', NULL, NULL, NULL),
('V01-P0003', 1, 'MAY THE 26 1619', '1619-05-26', '1619-05-26', false),
('V01-P0003', 2, 'PRESENT', NULL, NULL, NULL),
('V01-P0003', 3, 'Mr Treasuror Sir Edwin Sandys', NULL, NULL, NULL),
('V01-P0003', 4, 'Mr Deputie Ferrar', NULL, NULL, NULL),
('V01-P0003', 5, 'Mr Wolstenholme', NULL, NULL, NULL),
('V01-P0004', 0, 'JUNE 8, 1619 6', '1619-06-08', '1619-06-08', false),
('V01-P0004', 1, 'Mr Abdy', NULL, NULL, NULL),
('V01-P0004', 2, 'Sir Iohn Dauers', NULL, NULL, NULL),
('V01-P0004', 3, 'The said Sir John was by the court at length desired to write home.', NULL, NULL, NULL),
('V01-P0005', 0, 'JUNE 9, 1628 7', '1628-06-09', '1628-06-09', false),
('V01-P0005', 1, 'A note of the shipping men and prouisions sent to Virginia by the treasurer', NULL, NULL, NULL),
('V01-P0006', 0, 'Adams, Thomas, 12, 14.', NULL, NULL, NULL),
('V01-P0006', 1, 'Bacon, 22; 31-33.', NULL, NULL, NULL),
('V01-P0006', 2, 'Cape Henry, 4.', NULL, NULL, NULL),
('V01-P0007', 0, 'A plate', NULL, NULL, NULL),
('V01-P0008', 0, 'Dale, Sir Thomas, 7, 9.', NULL, NULL, NULL),
('V01-P0008', 1, 'Elizabeth City, 22.', NULL, NULL, NULL),
('V03-P0001', 0, '1607 1', '1607-01-01', '1607-12-31', false),
('V03-P0001', 1, 'I. COUNCIL IN VIRGINIA. LETTER TO THE COUNCIL IN ENGLAND', NULL, NULL, NULL),
('V03-P0001', 2, 'JUNE 22, 1607', '1607-06-22', '1607-06-22', false),
('V03-P0001', 3, 'Document in the Library', NULL, NULL, NULL),
('V03-P0001', 4, 'We acknowledge our selves.', NULL, NULL, NULL),
('V03-P0002', 0, '1607 2', '1607-01-01', '1607-12-31', false),
('V03-P0002', 1, 'and so wee rest.', NULL, NULL, NULL),
('V03-P0002', 2, 'II. A LETTER OF IOHN PORY', NULL, NULL, NULL),
('V03-P0002', 3, '20 JANUARY 1620', '1620-01-20', '1620-01-20', false),
('V03-P0002', 4, 'List of Records No. 12', NULL, NULL, NULL),
('V03-P0002', 5, 'From Virginia with great hast.', NULL, NULL, NULL)
) v(c0, c1, c2, c3, c4, c5)"""
EXPECTED["date_pages"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "volume", CAST(c2 AS BIGINT) AS "ord", CAST(c3 AS DATE) AS "start", CAST(c4 AS DATE) AS "end", CAST(c5 AS VARCHAR) AS "source", CAST(c6 AS BOOLEAN) AS "corrected", CAST(c7 AS VARCHAR) AS "confidence", CAST(c8 AS VARCHAR) AS "header_line"
FROM (VALUES
('V01-P0001', 1, 1, '1619-04-28', '1619-04-28', 'running_header', false, 'high', 'APRIL 28, 1619 3'),
('V01-P0002', 1, 2, '1619-05-01', '1619-05-31', 'running_header', false, 'high', 'MAY 1619 4'),
('V01-P0003', 1, 3, '1619-05-31', '1619-06-08', 'between_headers', false, 'medium', 'no date here'),
('V01-P0004', 1, 4, '1619-06-08', '1619-06-08', 'running_header', false, 'high', 'JUNE 8, 1619 6'),
('V01-P0005', 1, 5, '1622-06-09', '1622-06-09', 'running_header', true, 'low', 'JUNE 9, 1628 7'),
('V01-P0006', 1, 6, '1619-06-08', '1619-06-08', 'inherited', false, 'medium', 'Adams, Thomas, 12, 14.'),
('V01-P0007', 1, 7, '1619-06-08', '1619-06-08', 'inherited', false, 'medium', 'A plate'),
('V01-P0008', 1, 8, '1619-06-08', '1619-06-08', 'inherited', false, 'medium', 'Dale, Sir Thomas, 7, 9.'),
('V03-P0001', 3, 1, '1607-01-01', '1607-12-31', 'running_header', false, 'high', '1607 1'),
('V03-P0002', 3, 2, '1607-01-01', '1607-12-31', 'running_header', false, 'high', '1607 2')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8)"""
EXPECTED["segments"] = r"""SELECT CAST(c0 AS VARCHAR) AS "segment_id", CAST(c1 AS VARCHAR) AS "page_id", CAST(c2 AS INTEGER) AS "volume", CAST(c3 AS BIGINT) AS "ord", CAST(c4 AS INTEGER) AS "char_start", CAST(c5 AS INTEGER) AS "char_end", CAST(c6 AS DATE) AS "date_start", CAST(c7 AS DATE) AS "date_end", CAST(c8 AS VARCHAR) AS "date_source", CAST(c9 AS VARCHAR) AS "confidence", CAST(c10 AS VARCHAR) AS "heading"
FROM (VALUES
('V01-P0001-S01', 'V01-P0001', 1, 1, 0, 17, '1619-04-28', '1619-04-28', 'running_header', 'high', ''),
('V01-P0001-S02', 'V01-P0001', 1, 1, 17, 212, '1619-04-28', '1619-04-28', 'meeting_heading', 'high', 'A COURT HELD FOR VIRGINIA THE 28 OF APRIL 1619 PRESENT'),
('V01-P0002-S01', 'V01-P0002', 1, 2, 0, 185, '1619-04-28', '1619-04-28', 'continued_meeting', 'high', ''),
('V01-P0003-S01', 'V01-P0003', 1, 3, 0, 13, '1619-04-28', '1619-04-28', 'continued_meeting', 'high', ''),
('V01-P0003-S02', 'V01-P0003', 1, 3, 13, 100, '1619-05-26', '1619-05-26', 'meeting_heading', 'high', 'MAY THE 26 1619 PRESENT'),
('V01-P0004-S01', 'V01-P0004', 1, 4, 0, 106, '1619-05-26', '1619-05-26', 'continued_meeting', 'high', ''),
('V01-P0005-S01', 'V01-P0005', 1, 5, 0, 90, '1622-06-09', '1622-06-09', 'running_header', 'low', ''),
('V01-P0006-S01', 'V01-P0006', 1, 6, 0, 55, '1619-05-26', '1619-05-26', 'continued_meeting', 'high', ''),
('V01-P0007-S01', 'V01-P0007', 1, 7, 0, 7, '1619-05-26', '1619-05-26', 'continued_meeting', 'high', ''),
('V01-P0008-S01', 'V01-P0008', 1, 8, 0, 43, '1619-05-26', '1619-05-26', 'continued_meeting', 'high', ''),
('V03-P0001-S01', 'V03-P0001', 3, 1, 0, 7, '1607-01-01', '1607-12-31', 'running_header', 'high', ''),
('V03-P0001-S02', 'V03-P0001', 3, 1, 7, 128, '1607-06-22', '1607-06-22', 'document_heading', 'high', 'I. COUNCIL IN VIRGINIA. LETTER TO THE COUNCIL IN ENGLAND JUNE 22, 1607'),
('V03-P0002-S01', 'V03-P0002', 3, 2, 0, 24, '1607-06-22', '1607-06-22', 'continued_document', 'high', ''),
('V03-P0002-S02', 'V03-P0002', 3, 2, 24, 119, '1620-01-20', '1620-01-20', 'document_heading', 'high', 'II. A LETTER OF IOHN PORY 20 JANUARY 1620')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10)"""
EXPECTED["page_roles"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS VARCHAR) AS "role"
FROM (VALUES
('V01-P0001', 'record'),
('V01-P0002', 'record'),
('V01-P0003', 'record'),
('V01-P0004', 'record'),
('V01-P0005', 'record'),
('V01-P0006', 'index'),
('V01-P0007', 'index'),
('V01-P0008', 'index'),
('V03-P0001', 'record'),
('V03-P0002', 'record')
) v(c0, c1)"""
EXPECTED["attendance_carry"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "start", CAST(c2 AS INTEGER) AS "end"
FROM (VALUES
('V01-P0001', 64, 130),
('V01-P0003', 29, 100),
('V01-P0004', 15, 39)
) v(c0, c1, c2)"""
EXPECTED["relations_neighbour"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS VARCHAR) AS "name", CAST(c2 AS VARCHAR) AS "b_name", CAST(c3 AS VARCHAR) AS "relation", CAST(c4 AS VARCHAR) AS "confidence", CAST(c5 AS VARCHAR) AS "cue"
FROM (VALUES
('V01-P0002', 'Captain Smith', 'Mary Smith', 'kin_of', 'high', 'his wife'),
('V01-P0002', 'Sir Thomas Smith', 'Virginia', 'travel_to', 'medium', 'went to')
) v(c0, c1, c2, c3, c4, c5)"""
EXPECTED["relations_spread"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS VARCHAR) AS "relation", CAST(c2 AS VARCHAR) AS "confidence", CAST(c3 AS VARCHAR) AS "cue", CAST(c4 AS VARCHAR) AS "subject", CAST(c5 AS VARCHAR) AS "subject_type", CAST(c6 AS VARCHAR) AS "object", CAST(c7 AS VARCHAR) AS "object_type", CAST(c8 AS VARCHAR) AS "sentence"
FROM (VALUES
('V01-P0002', 'kin_of', 'high', 'his wife', 'Mary Smith', 'person', 'Captain Smith', 'person', 'Sir Thomas Smith went to Virginia, and Bermuda. [[Captain Smith]] his wife [[Mary Smith]] was there.'),
('V01-P0002', 'travel_to', 'medium', 'went to', 'Sir Thomas Smith', 'person', 'Bermuda', 'place', 'MAY 1619 4 It was ordered that Captaine Argall, late Governor of Virginia, should come home. [[Sir Thomas Smith]] went to Virginia, and [[Bermuda]]. Captain Smith his wife Mary Smith was there.'),
('V01-P0002', 'travel_to', 'medium', 'went to', 'Sir Thomas Smith', 'person', 'Virginia', 'place', 'MAY 1619 4 It was ordered that Captaine Argall, late Governor of Virginia, should come home. [[Sir Thomas Smith]] went to [[Virginia]], and Bermuda.')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8)"""
EXPECTED["relation_rules"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS VARCHAR) AS "relation", CAST(c2 AS VARCHAR) AS "confidence", CAST(c3 AS VARCHAR) AS "cue", CAST(c4 AS VARCHAR) AS "subject", CAST(c5 AS VARCHAR) AS "subject_type", CAST(c6 AS VARCHAR) AS "object", CAST(c7 AS VARCHAR) AS "object_type", CAST(c8 AS VARCHAR) AS "subject_key", CAST(c9 AS VARCHAR) AS "object_key", CAST(c10 AS VARCHAR) AS "sentence"
FROM (VALUES
('s00', 'office_in', 'high', 'gouernor and captaine generall of', 'Sir Iohn Wyatt', 'person', 'Virginia', 'place', 'K-Sir Iohn Wyatt', 'K-Virginia', '[[Sir Iohn Wyatt]] Gouernor and Captaine generall of [[Virginia]].'),
('s01', 'commands', 'high', 'command of', 'Mr Pountis', 'person', 'Henrico', 'place', 'K-Mr Pountis', 'K-Henrico', '[[Mr Pountis]] hath the command of [[Henrico]].'),
('s02', 'property_at', 'high', 'his house at', 'Mr Bland', 'person', 'Kent', 'place', 'K-Mr Bland', 'K-Kent', '[[Mr Bland]] his house at [[Kent]].'),
('s03', 'land_at', 'high', '50 acres of land neere', 'Thomas Rich', 'person', 'Henrico', 'place', 'K-Thomas Rich', 'K-Henrico', '[[Thomas Rich]] had 50 acres of land neere [[Henrico]].'),
('s04', 'killed_at', 'high', 'slayne at', 'George Poole', 'person', 'Henrico', 'place', 'K-George Poole', 'K-Henrico', '[[George Poole]] was slayne at [[Henrico]].'),
('s05', 'travel_to', 'medium', 'went to', 'Anne Wood', 'person', 'Bermuda', 'place', 'K-Anne Wood', 'K-Bermuda', '[[Anne Wood]] went to [[Bermuda]], and Virginia.'),
('s05', 'travel_to', 'medium', 'went to', 'Anne Wood', 'person', 'Virginia', 'place', 'K-Anne Wood', 'K-Virginia', '[[Anne Wood]] went to Bermuda, and [[Virginia]].'),
('s06', 'travel_from', 'medium', 'lately come from', 'Capt. Poole', 'person', 'Bermuda', 'place', 'K-Capt. Poole', 'K-Bermuda', '[[Capt. Poole]] lately come from [[Bermuda]].'),
('s07', 'resident_of', 'medium', 'dwelling in the parish of', 'Iane Moore', 'person', 'Kent', 'place', 'K-Iane Moore', 'K-Kent', '[[Iane Moore]] dwelling in the parish of [[Kent]].'),
('s08', 'written_from', 'medium', 'indorsed … from', 'Mr Pory', 'person', 'Virginia', 'place', 'K-Mr Pory', 'K-Virginia', '[Indorsed:] [[Mr Pory]]: from [[Virginia]].'),
('s10', 'action_against', 'high', 'vpon', 'Capt. Poole', 'person', 'Nansamums', 'group', 'K-Capt. Poole', 'K-Nansamums', '[[Capt. Poole]] marched vpon [[Nansamums]], & Wariscoyacks.'),
('s10', 'action_against', 'high', 'vpon', 'Capt. Poole', 'person', 'Wariscoyacks', 'group', 'K-Capt. Poole', 'K-Wariscoyacks', '[[Capt. Poole]] marched vpon Nansamums, & [[Wariscoyacks]].'),
('s11', 'trade_with', 'high', 'trade with', 'Capt. Poole', 'person', 'Patawomecks', 'group', 'K-Capt. Poole', 'K-Patawomecks', '[[Capt. Poole]] had trade with [[Patawomecks]].'),
('s12', 'peace_with', 'high', 'peace with', 'Mr Wood', 'person', 'Patawomecks', 'group', 'K-Mr Wood', 'K-Patawomecks', '[[Mr Wood]] made a peace with [[Patawomecks]].'),
('s13', 'kin_of', 'high', 'the daughter of', 'Mary Moore', 'person', 'Iohn Moore', 'person', 'K-Mary Moore', 'K-Iohn Moore', '[[Mary Moore]] the daughter of [[Iohn Moore]], and Thomas Bland.'),
('s14', 'kin_of', 'high', 'his wife', 'Anne Bland', 'person', 'Thomas Bland', 'person', 'K-Anne Bland', 'K-Thomas Bland', '[[Thomas Bland]] his wife [[Anne Bland]].'),
('s16', 'agent_of', 'high', 'servant to', 'Iohn Rowe', 'person', 'Robert Cole', 'person', 'K-Iohn Rowe', 'K-Robert Cole', '[[Iohn Rowe]] servant to [[Robert Cole]].'),
('s17', 'agent_of', 'high', 'his man', 'Iohn Rowe', 'person', 'Robert Cole', 'person', 'K-Iohn Rowe', 'K-Robert Cole', '[[Robert Cole]] his man [[Iohn Rowe]].'),
('s18', 'letter_to', 'high', 'a letter to', 'Mr Wood', 'person', 'Mr Pory', 'person', 'K-Mr Wood', 'K-Mr Pory', '[[Mr Wood]]. A letter to [[Mr Pory]].'),
('s19', 'letter_to', 'high', 'wrote vnto', 'Mr Wood', 'person', 'Mr Pory', 'person', 'K-Mr Wood', 'K-Mr Pory', '[[Mr Wood]] wrote vnto [[Mr Pory]].'),
('s20', 'complaint_against', 'high', 'complayned of', 'Mr Cole', 'person', 'Mr Rowe', 'person', 'K-Mr Cole', 'K-Mr Rowe', '[[Mr Cole]] complayned of [[Mr Rowe]].'),
('s21', 'complaint_against', 'high', 'suit against the said', 'Mr Cole', 'person', 'Mr Rowe', 'person', 'K-Mr Cole', 'K-Mr Rowe', '[[Mr Cole]] his suit against the said [[Mr Rowe]].'),
('s22', 'transfer_to', 'high', 'passed three shares vnto', 'Mr Cole', 'person', 'Mr Rowe', 'person', 'K-Mr Cole', 'K-Mr Rowe', '[[Mr Cole]] passed three shares vnto [[Mr Rowe]].'),
('s23', 'transfer_to', 'high', 'to for 3 shares', 'Mr Cole', 'person', 'Mr Rowe', 'person', 'K-Mr Cole', 'K-Mr Rowe', '[[Mr Cole]] to [[Mr Rowe]] for 3 shares.'),
('s24', 'married', 'high', 'maried to', 'Anne Wood', 'person', 'Iohn Rowe', 'person', 'K-Anne Wood', 'K-Iohn Rowe', '[[Anne Wood]] maried to [[Iohn Rowe]].'),
('s25', 'people_at', 'high', 'of … his people', 'Mr Bland', 'person', 'Henrico', 'place', 'K-Mr Bland', 'K-Henrico', 'At [[Henrico]] of [[Mr Bland]] his people.'),
('s26', 'office_in', 'high', 'gouernor of', 'Mr Bland', 'person', 'Virginia', 'place', 'K-Mr Bland', 'K-Virginia', 'the Gouernor of [[Virginia]], [[Mr Bland]] came.')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10)"""
EXPECTED["mention_decisions"] = r"""SELECT CAST(c0 AS VARCHAR) AS "mention_id", CAST(c1 AS VARCHAR) AS "page_id", CAST(c2 AS INTEGER) AS "start", CAST(c3 AS INTEGER) AS "end", CAST(c4 AS VARCHAR) AS "span", CAST(c5 AS VARCHAR) AS "label", CAST(c6 AS VARCHAR) AS "entity", CAST(c7 AS VARCHAR) AS "source"
FROM (VALUES
('V01-P0001-N00019-00024', 'V01-P0001', 19, 24, 'COURT', 'NOT_ENTITY', 'court', 'not_entity'),
('V01-P0001-N00034-00042', 'V01-P0001', 34, 42, 'VIRGINIA', 'PLACE', 'NW-001', 'authority'),
('V01-P0001-N00072-00088', 'V01-P0001', 72, 88, 'Sir Edwin Sandys', 'PERSON', 'Sandys, Edwin', 'authority'),
('V01-P0001-N00090-00104', 'V01-P0001', 90, 104, 'mr Iohn Ferrar', 'PERSON', NULL, 'title'),
('V01-P0001-N00106-00114', 'V01-P0001', 106, 114, 'mr Wrote', 'PERSON', NULL, 'title'),
('V01-P0001-N00115-00129', 'V01-P0001', 115, 129, 'Lord Sheffield', 'PERSON', NULL, 'title'),
('V01-P0001-N00135-00140', 'V01-P0001', 135, 140, 'court', 'NOT_ENTITY', 'court', 'not_entity'),
('V01-P0002-N00031-00046', 'V01-P0002', 31, 46, 'Captaine Argall', 'PERSON', NULL, 'title'),
('V01-P0002-N00065-00073', 'V01-P0002', 65, 73, 'Virginia', 'PLACE', 'NW-001', 'authority'),
('V01-P0002-N00097-00109', 'V01-P0002', 97, 109, 'Thomas Smith', 'PERSON', 'Smith, Thomas', 'authority'),
('V01-P0002-N00118-00126', 'V01-P0002', 118, 126, 'Virginia', 'PLACE', 'NW-001', 'authority'),
('V01-P0002-N00132-00139', 'V01-P0002', 132, 139, 'Bermuda', 'PLACE', 'NW-002', 'authority'),
('V01-P0002-N00141-00154', 'V01-P0002', 141, 154, 'Captain Smith', 'PERSON', NULL, 'title'),
('V01-P0003-N00050-00066', 'V01-P0003', 50, 66, 'Sir Edwin Sandys', 'PERSON', 'Sandys, Edwin', 'authority'),
('V01-P0003-N00085-00100', 'V01-P0003', 85, 100, 'Mr Wolstenholme', 'PERSON', NULL, 'title'),
('V01-P0004-N00015-00022', 'V01-P0004', 15, 22, 'Mr Abdy', 'PERSON', NULL, 'title'),
('V01-P0004-N00023-00038', 'V01-P0004', 23, 38, 'Sir Iohn Dauers', 'PERSON', NULL, 'title'),
('V01-P0004-N00048-00056', 'V01-P0004', 48, 56, 'Sir John', 'PERSON', NULL, 'title'),
('V01-P0004-N00068-00073', 'V01-P0004', 68, 73, 'court', 'NOT_ENTITY', 'court', 'not_entity'),
('V01-P0005-N00065-00073', 'V01-P0005', 65, 73, 'Virginia', 'PLACE', 'NW-001', 'authority'),
('V01-P0008-N00006-00016', 'V01-P0008', 6, 16, 'Sir Thomas', 'PERSON', NULL, 'title'),
('V03-P0001-N00021-00029', 'V03-P0001', 21, 29, 'VIRGINIA', 'PLACE', 'NW-001', 'authority'),
('V03-P0002-N00094-00102', 'V03-P0002', 94, 102, 'Virginia', 'PLACE', 'NW-001', 'authority')
) v(c0, c1, c2, c3, c4, c5, c6, c7)"""
EXPECTED["group_mentions"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "start", CAST(c2 AS INTEGER) AS "end", CAST(c3 AS VARCHAR) AS "word", CAST(c4 AS VARCHAR) AS "entity", CAST(c5 AS VARCHAR) AS "category", CAST(c6 AS VARCHAR) AS "match_type", CAST(c7 AS DOUBLE) AS "score", CAST(c8 AS VARCHAR) AS "reading"
FROM (VALUES
('p1', 22, 35, 'Chickahominys', 'Chickahominy', 'group', 'variant', 1.0, 'group'),
('p1', 4, 13, 'Powhatans', 'Powhatan', 'group', 'variant', 1.0, 'group'),
('p2', 0, 8, 'Powhatan', 'Powhatan', 'group', 'exact', 1.0, 'group'),
('p2', 25, 32, 'sauages', 'savages', 'collective', 'exact', 1.0, 'collective')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8)"""
EXPECTED["merged_names"] = r"""SELECT CAST(c0 AS VARCHAR) AS "name", CAST(c1 AS VARCHAR) AS "group"
FROM (VALUES
('John Rolfe', 'John Rolfe'),
('John Smith', 'John Smith'),
('John Smyth', 'John Smyth'),
('John Smythe', 'John Smyth'),
('Mary Smith', 'Mary Smith')
) v(c0, c1)"""
EXPECTED["layout_classify"] = r"""SELECT CAST(c0 AS INTEGER) AS "leaf", CAST(c1 AS VARCHAR) AS "role", CAST(c2 AS VARCHAR) AS "text", CAST(c3 AS DOUBLE) AS "conf"
FROM (VALUES
(1, 'body', 'the 0 line of the body runs over the whole width here

the 1 line of the body runs over the whole width here

the 2 line of the body runs over the whole width here

the 3 line of the body runs over the whole width here

the 4 line of the body runs over the whole width here

the 5 line of the body runs over the whole width here

the 6 line of the body runs over the whole width here

the 7 line of the body runs over the whole width here

the 8 line of the body runs over the whole width here

the 9 line of the body runs over the whole width here', 90.0),
(1, 'footnote', '1 See the note', 90.0),
(1, 'head', 'A COURT HELD', 90.0),
(1, 'margin', 'Land graunted
to Smith', 90.0),
(2, 'body', 'the 0 line of the body runs over the whole width here

the 1 line of the body runs over the whole width here

the 2 line of the body runs over the whole width here

the 3 line of the body runs over the whole width here

the 4 line of the body runs over the whole width here

the 5 line of the body runs over the whole width here

the 6 line of the body runs over the whole width here

the 7 line of the body runs over the whole width here

the 8 line of the body runs over the whole width here

the 9 line of the body runs over the whole width here', 90.0),
(2, 'footnote', '1 See the note', 90.0),
(2, 'head', 'A COURT HELD', 90.0),
(2, 'margin', 'Land graunted
to Smith', 90.0)
) v(c0, c1, c2, c3)"""
EXPECTED["layout_notes"] = r"""SELECT CAST(c0 AS INTEGER) AS "leaf", CAST(c1 AS INTEGER) AS "block", CAST(c2 AS VARCHAR) AS "side", CAST(c3 AS INTEGER) AS "y", CAST(c4 AS VARCHAR) AS "text"
FROM (VALUES
(1, 12, 'left', 300, 'Land graunted to Smith'),
(2, 12, 'left', 300, 'Land graunted to Smith')
) v(c0, c1, c2, c3, c4)"""
EXPECTED["map_rings"] = r"""SELECT CAST(c0 AS BIGINT) AS "id", CAST(c1 AS VARCHAR) AS "clipped"
FROM (VALUES
(0, '[{"lon":10.0,"lat":0.0},{"lon":9.8769,"lat":1.5643},{"lon":9.5106,"lat":3.0902},{"lon":8.9101,"lat":4.5399},{"lon":8.0902,"lat":5.8779},{"lon":7.0711,"lat":7.0711},{"lon":5.8779,"lat":8.0902},{"lon":4.5399,"lat":8.9101},{"lon":3.0902,"lat":9.5106},{"lon":1.5643,"lat":9.8769},{"lon":0.0,"lat":10.0},{"lon":0.0,"lat":0.0}]')
) v(c0, c1)"""
EXPECTED["record_titles"] = r"""SELECT CAST(c0 AS VARCHAR) AS "heading", CAST(c1 AS VARCHAR) AS "title"
FROM (VALUES
('CCLXXX. COUNCIL IN VIRGINIA. LETTER TO THE COMPANY JANUARY 20, 1622 Manuscript Records', 'CCLXXX. COUNCIL IN VIRGINIA. LETTER TO THE COMPANY'),
('I. SIR THOMAS GATES. A COMMISSION 1609 Document in the Library', 'I. SIR THOMAS GATES. A COMMISSION'),
('Short', 'Short')
) v(c0, c1)"""
EXPECTED["listed_entries"] = r"""SELECT CAST(c0 AS INTEGER) AS "number", CAST(c1 AS VARCHAR) AS "description"
FROM (VALUES
(1, 'A letter to Sir Thomas Smith'),
(2, 'A note of shipping'),
(3, 'The last one')
) v(c0, c1)"""
EXPECTED["titled_context"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "start", CAST(c2 AS VARCHAR) AS "span", CAST(c3 AS VARCHAR) AS "title"
FROM (VALUES
('V01-P0001', 109, 'Wrote', 'mr'),
('V01-P0001', 120, 'Sheffield', 'lord'),
('V01-P0001', 76, 'Edwin', 'sir'),
('V01-P0001', 93, 'Iohn', 'mr'),
('V01-P0002', 149, 'Smith', 'captain'),
('V01-P0002', 40, 'Argall', 'captaine'),
('V01-P0002', 97, 'Thomas', 'sir'),
('V01-P0003', 40, 'Treasuror', 'mr'),
('V01-P0003', 54, 'Edwin', 'sir'),
('V01-P0003', 70, 'Deputie', 'mr'),
('V01-P0003', 88, 'Wolstenholme', 'mr'),
('V01-P0004', 18, 'Abdy', 'mr'),
('V01-P0004', 27, 'Iohn', 'sir'),
('V01-P0004', 52, 'John', 'sir'),
('V01-P0008', 10, 'Thomas', 'sir')
) v(c0, c1, c2, c3)"""
EXPECTED["matcher_entries"] = r"""SELECT CAST(c0 AS VARCHAR) AS "label", CAST(c1 AS VARCHAR) AS "entity", CAST(c2 AS VARCHAR) AS "form", CAST(c3 AS INTEGER) AS "priority", CAST(c4 AS INTEGER) AS "ord"
FROM (VALUES
('NOT_ENTITY', '', 'Cape Marchant', 1, 3),
('NOT_ENTITY', '', 'Cape Merchant', 1, 3),
('NOT_ENTITY', '', 'Cape Mercht', 1, 3),
('NOT_ENTITY', '', 'Councel', 1, 3),
('NOT_ENTITY', '', 'Councell', 1, 3),
('NOT_ENTITY', '', 'Counsel', 1, 3),
('NOT_ENTITY', '', 'Counsell', 1, 3),
('NOT_ENTITY', '', 'Deputie', 1, 3),
('NOT_ENTITY', '', 'Deputy', 1, 3),
('NOT_ENTITY', '', 'Ibid', 1, 3),
('NOT_ENTITY', '', 'Maiestie', 1, 3),
('NOT_ENTITY', '', 'Majesty', 1, 3),
('NOT_ENTITY', '', 'Old Court', 1, 3),
('NOT_ENTITY', '', 'Statutes', 1, 3),
('NOT_ENTITY', '', 'Tiger', 1, 3),
('NOT_ENTITY', '', 'Treasurer', 1, 3),
('NOT_ENTITY', '', 'Treasuror', 1, 3),
('PERSON', 'Bishop of London', 'Bishop of London', 0, 1),
('PERSON', 'Bishop of London', 'John King', 0, 1),
('PERSON', 'CONTEXT:0', 'the lord Treasuror', 0, 0),
('PERSON', 'CONTEXT:1', 'my lord', 0, 0),
('PERSON', 'Pocahontas', 'Lady Rebecca', 0, 1),
('PERSON', 'Pocahontas', 'Matoaka', 0, 1),
('PERSON', 'Pocahontas', 'Pocahontas', 0, 1),
('PERSON', 'Sandys, Edwin', 'Edwin Sandys', 0, 1),
('PERSON', 'Sandys, Edwin', 'Sandys, Edwin', 0, 1),
('PERSON', 'Sandys, Edwin', 'Sir Edwin Sandys', 0, 1),
('PLACE', 'NW-001', 'Virginia Colony', 0, 2),
('PLACE', 'NW-001', 'Virginia', 0, 2)
) v(c0, c1, c2, c3, c4)"""
EXPECTED["surname_set"] = r"""SELECT CAST(c0 AS VARCHAR) AS "surname"
FROM (VALUES
('king'),
('rebecca'),
('sandys')
) v(c0)"""
EXPECTED["bare_surnames"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS VARCHAR) AS "label", CAST(c2 AS VARCHAR) AS "entity", CAST(c3 AS VARCHAR) AS "span", CAST(c4 AS VARCHAR) AS "sentence"
FROM (VALUES
('p1', 'PLACE', 'OW-1', 'Sandys', 'mr Sandys moved the court')
) v(c0, c1, c2, c3, c4)"""
EXPECTED["cleaned_mentions"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "start", CAST(c2 AS VARCHAR) AS "span", CAST(c3 AS INTEGER) AS "end", CAST(c4 AS VARCHAR) AS "raw_span", CAST(c5 AS BOOLEAN) AS "span_was_trimmed", CAST(c6 AS VARCHAR) AS "title", CAST(c7 AS VARCHAR) AS "name_string", CAST(c8 AS VARCHAR) AS "label", CAST(c9 AS VARCHAR) AS "mention_kind", CAST(c10 AS VARCHAR) AS "mention_id"
FROM (VALUES
('p', 10, 'Sir Edwin Sandys', 26, 'Sir Edwin Sandys moued', true, 'Sir', 'Edwin Sandys', 'PERSON_REF', 'title_surname', 'p-M00010-00026'),
('p', 100, 'Edwin Sandys', 112, 'Edwin Sandys,', true, NULL, 'Edwin Sandys', 'PERSON_NAME', 'explicit_name', 'p-M00100-00112'),
('p', 120, 'Iohn Smith', 130, 'Iohn Smith and others', true, NULL, 'Iohn Smith', 'PERSON_NAME', 'explicit_name', 'p-M00120-00130'),
('p', 40, 'Deputie', 47, 'Deputie', false, 'Deputy', NULL, 'TITLE_OR_ROLE', 'role_reference', 'p-M00040-00047'),
('p', 61, 'Sandys', 67, '(Sandys).', true, NULL, 'Sandys', 'PERSON_REF', 'surname_only', 'p-M00061-00067'),
('p', 80, 'Nos', 83, 'Nos.', true, NULL, NULL, 'EDITORIAL_REFERENCE', 'relational_reference', 'p-M00080-00083'),
('p', 90, 'Counsell', 98, 'Counsell', false, NULL, 'Counsell', 'ORG_OR_COMMITTEE', 'relational_reference', 'p-M00090-00098')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10)"""
EXPECTED["note_mentions"] = r"""SELECT CAST(c0 AS VARCHAR) AS "page_id", CAST(c1 AS INTEGER) AS "note_index", CAST(c2 AS VARCHAR) AS "note_kind", CAST(c3 AS INTEGER) AS "start", CAST(c4 AS INTEGER) AS "end", CAST(c5 AS VARCHAR) AS "span", CAST(c6 AS VARCHAR) AS "label", CAST(c7 AS VARCHAR) AS "entity", CAST(c8 AS VARCHAR) AS "source"
FROM (VALUES
('V01-P0002', 0, 'summary', 17, 25, 'Virginia', 'PLACE', 'NW-001', 'authority'),
('V01-P0002', 0, 'summary', 29, 45, 'Sir Edwin Sandys', 'PERSON', 'Sandys, Edwin', 'authority'),
('V01-P0002', 1, 'attendance_fragment', 0, 10, 'm'' Steward', 'PERSON', NULL, 'title'),
('V01-P0002', 1, 'attendance_fragment', 12, 20, 'm'' Binge', 'PERSON', NULL, 'title'),
('V01-P0002', 1, 'attendance_fragment', 22, 32, 'm'' Tomlins', 'PERSON', NULL, 'title')
) v(c0, c1, c2, c3, c4, c5, c6, c7, c8)"""
EXPECTED["flag_counts"] = r"""SELECT CAST(c0 AS VARCHAR) AS "kind", CAST(c1 AS BIGINT) AS "n"
FROM (VALUES
('page: index', 3),
('page: record', 7),
('span: editorial_metadata', 1),
('span: running_head', 7)
) v(c0, c1)"""
