"""Variant names, entities without keys, and addresses."""

import pytest

from tamis.llm.addresses import readings, same_places, same_street, word_keys
from tamis.llm.parties import DIFFERENT, EQUAL, PARTLY, SLIP, UNKNOWN, country_codes, date_of, dates_agree
from tamis.llm.resolution import propagate, same_persons
from tamis.llm.spelling import company_likeness, likeness, person_likeness, spellings
from tamis.llm.variants import name_variants

CLIENTS = "id long, client_id string, client_type string, client_first_name string, client_last_name string, client_maiden_name string, client_aliases string, client_dob string, nationality string, birth_country string, ref string"
LISTED = "id long, entity_id string, entity_type string, primary_name string, individual_name_parsed string, aliases string, dates_of_birth string, countries string, imo_number string, lei_number string, passport_documents string, class string"


def client(i, ref, first, last, dob=None, nationality=None, maiden=None, aliases=None):
    return (i, ref, "PP", first, last, maiden, aliases, dob, nationality, None, "clash")


def listed(i, ref, name, dob=None, countries=None, kind="I", imo=None, aliases=None, parsed=None):
    return (i, ref, kind, name, parsed, aliases, dob, countries, imo, None, None, "clash")


ENTITIES = [
    listed(1, "EU.1", "EL LABUSABADI, Mohsen", '["1969-05-11"]', '{"citizenship": ["LB"]}'), listed(2, "EU.1 ", "EL LABUSABADI, Mohsen", '["1969-05-11"]', '{"citizenship": ["LB"]}'),
    listed(3, "OFAC-1", "Mohsen El Labusabadi", '["1969"]', None), listed(4, "OFAC-2", "Mohsen El Labusabadi", '["1970-01-02"]', None),
    listed(5, "UN-1", "Haren Shipping Ltd", None, '{"residence": ["GB"]}', "E"), listed(6, "DGT1", "HAREN SHPG", None, None, "E"), listed(7, "DGT2", "Haren Shipping 7", None, None, "E"),
    listed(8, "UN-V1", "MV Haren Star", None, None, "V", "IMO 9074729"), listed(9, "UN-V2", "Haren Star", None, None, "V", "9074730"), listed(10, None, "x y"), listed(11, "UN-2", None, None, None), listed(12, "UN-3", " ", "broken", "{"),
]


def test_name_variants(spark):
    people = [
        client(1, "C1", "Wilhelm", "Helureichhoff", "1981-06-01", "DEU"), client(2, "C2", "Wilehlm", "HELUREIKHHOFF", "01/06/1981", "DE"), client(3, "C3", None, "Helureichhoff, Wilhelm", None, "Germany"),
        client(4, "C4", "Wilhelm", "Helureichhoff", "1955-02-03", "DE"), client(5, "C5", "Ingeborg", "Helureichhoff", "1981-06-01", "DE"), client(6, "C6", "Wilhelm", "Helureichhoff", "1981-06-01", "FR"),
        client(7, None, "Wilhelm", "Helureichhoff", "1981-06-01", "DE"), client(8, "C8", None, None), client(9, "C1\t", "Wilhelm", "Helureichhoff", "1981-06-01", "DEU"),
        (10, "C9", "PM", "Wilhelm", "Helureichhoff", None, None, "1981-06-01", "DE", None, "x"), client(11, "T1", "Ana", "Roca", "1990-01-01"), client(12, "T2", "Ana", "Roca", "1990-01-01"),
    ]
    got = {tuple(r) for r in name_variants(spark.createDataFrame(people, CLIENTS), spark.createDataFrame(ENTITIES, LISTED)).collect()}
    assert got == {("C1", "C2"), ("C1", "C3"), ("C2", "C3"), ("C3", "C4"), ("T1", "T2"), ("EU.1", "OFAC-1"), ("DGT1", "UN-1")}
    assert name_variants(spark.createDataFrame([], CLIENTS), spark.createDataFrame([], LISTED)).count() == 0


def test_names_without_dates(spark):
    """Slips, an initial of another sound and added names must not keep a pair without a birth date from the verifier."""
    people = [
        client(1, "A1", "Johannes", "Krugwaldke", None, "DE"), client(2, "A2", "Johannes", "Rugwaldke", "1970-02-03", "DE"), client(3, "B1", "Leonid", "Vetarmarchuk"), client(4, "B2", "Timofei Leonid", "Vetarmrachuk", "1961-04-05", "UA"),
        client(5, "C1", "Ana Maria", "Lopertegui", None, "ES"), client(6, "C2", "Anna Maria", "Loperteguy", None, "ES"), client(7, "D1", "Johannes", "Adlerhorst", None, "DE"),
    ]
    got = {tuple(r) for r in name_variants(spark.createDataFrame(people, CLIENTS), spark.createDataFrame([], LISTED)).collect()}
    assert got == {("A1", "A2"), ("B1", "B2"), ("C1", "C2")}


def test_slips_of_dates(spark):
    """A date with one slip and a name with another: wrong digit, digits of month and day changed over, year off by one."""
    people = [
        client(1, "A1", "Lucien", "Charoviguard", "1975-05-12", "FR"), client(2, "A2", "Lucien", "Charovigaurd", "1975-05-17", "FR"), client(3, "B1", "Tarek", "Labeszerni", "1980-02-13", "TN"),
        client(4, "B2", "Tarek Mustapha", "Labeszerny", "1980-01-23", "TN"), client(5, "C1", "Harriet", "Wesstow", "1966-07-08", "GB"), client(6, "C2", "Hariett", "Wesstow", "1967-07-08", "GB"),
        client(7, "D1", "Lucien", "Marimlanaud", "1975-05-13", "FR"),
    ]
    book = spark.createDataFrame(people, CLIENTS)
    assert {tuple(r) for r in name_variants(book, spark.createDataFrame([], LISTED)).collect()} == {("A1", "A2"), ("B1", "B2"), ("C1", "C2")}
    names = [listed(1, "EU.1", "Lucien Charovigaurd", '["1975-05-17"]', '{"citizenship": ["FR"]}'), listed(2, "EU.2", "Labeszerny, Tarek Mustapha", '["1980-01-23"]', '{"citizenship": ["TN"]}')]
    found = {(r.client_id, r.entity_id) for r in same_persons(book, spark.createDataFrame(names, LISTED)).collect()}
    assert {("A1", "EU.1"), ("B1", "EU.2")} <= found


def test_same_persons(spark):
    people = [
        client(1, "C1", "Mohsen", "EL LABUSABADI", "11/05/1969", "Liban"), client(2, "C2", "Mohsin", "Al Labusabadi", "1969-05-11"), client(3, "C3", "Mohsen", "El Labusabadi", "1988-05-11", "LB"),
        client(4, "C4", "Karim", "El Labusabadi", "1969-05-11", "LB"), client(5, "C5", None, None), client(6, "C6", "Mohsen", "Zz", "1969-05-11", maiden="El Labusabadi", nationality="LB"),
    ]
    book, entities = spark.createDataFrame(people, CLIENTS), spark.createDataFrame(ENTITIES, LISTED)
    got = {(r.client_id, r.entity_id): r.probability for r in same_persons(book, entities).collect()}
    assert {k for k, p in got.items() if p >= 0.5} >= {("C1", "EU.1"), ("C2", "EU.1"), ("C1", "OFAC-1")} and all(0 <= p <= 1 for p in got.values())
    assert not any(c in ("C3", "C4", "C5") and p >= 0.5 for (c, _), p in got.items()) and got.get(("C6", "EU.1"), 0) >= 0.5
    assert same_persons(book.limit(0), entities).count() == 0


def test_propagation_is_exact_on_a_tree(spark):
    """One factor with two rivals: marginals are odds over one plus the sum of odds."""
    pairs = spark.createDataFrame([("x", 3.0, "f", "o1", "g1"), ("y", 1.0, "f", "o2", "g2")], "pair string, odds double, f string, option string, g string")
    got = {r.pair: r.probability for r in propagate(pairs, [(["f"], "option"), (["g"], "pair")], rounds=40, tolerance=1e-9).collect()}
    assert got == pytest.approx({"x": 3 / 5, "y": 1 / 5}, abs=1e-6)
    assert propagate(pairs.limit(0), [(["f"], "option")]).count() == 0


def test_spelling():
    w = lambda t: 3.0
    name = lambda s: spellings(s, False)[0]
    firm = lambda s: spellings(s, True)[0]
    assert person_likeness(name("Роза Иванова"), name("IVANOVA Roza"), w) == 1.0
    assert person_likeness(name("Charo del Monales"), name("Rosario Del Monales"), w) > 0.9 and person_likeness(name("E. Roche"), name("Emma Roche"), w) > 0.8
    assert person_likeness(name("Anna Roche"), name("Marc Roche"), w) < 0.7 and person_likeness(name("Roche"), name("Anna Roche"), w) == 0
    assert company_likeness(firm("Haren Trading S.A.R.L."), firm("HAREN TRDG SARL"), w) == 1.0 and company_likeness(firm("Haren Trading GmbH"), firm("Haren Trading SA"), w) == 0
    assert company_likeness(firm("Haren 7"), firm("Haren 8"), w) == 0 and likeness("aziz", "abdelaziz") > 0.8 and spellings(None, True) == [] and spellings("()", False) == []


def test_facts():
    assert [date_of(x) for x in ("1980-02-01", "01.02.1980", "1980/02/01", "1980", None, "x")] == ["19800201"] * 3 + ["19800000", "", ""]
    assert dates_agree(["19800201"], ["19800201", "1"]) == EQUAL and dates_agree(["19800201"], ["19800000"]) == PARTLY and dates_agree([], ["19800000"]) == UNKNOWN
    assert dates_agree(["19800201"], ["19800102"]) == SLIP and dates_agree(["19800201"], ["19810201"]) == SLIP and dates_agree(["19800201"], ["19990201"]) == DIFFERENT
    assert country_codes(" fr; DEU,Royaume-Uni") == {"FR", "DE", "GB"} and country_codes(None) == set()


@pytest.mark.parametrize(
    "address,city,number,kind,name,town",
    [
        ("56 Upper Bexmore Rd, 17099 BRADMOUTH", None, "56", "road", ["bexmore"], "bradmouth"), ("3. OG, 83 MÜLHOF STRASSE", "B", "83", "strasse", ["mulhof"], "b"), ("Falkweg 60", "S", "60", "weg", ["falk"], "s"),
        ("104 bis r. du Guibateau, Bât. A", "Lau Cedex 12", "104bis", "rue", ["guibateau"], "lau"), ("Pº Sanveredo 33a, 6º izq.", "x", "33a", "paseo", ["sanveredo"], "x"),
    ],
)
def test_readings(address, city, number, kind, name, town):
    (r,) = readings(address, city)
    assert (r[0], r[1], r[3], r[5]) == (number, kind, name, town)


def test_streets():
    assert same_street(("rue", [], ["marbaret"]), ("", [], ["marbarte"])) and not same_street(("rue", [], ["marbaret"]), ("avenue", [], ["marbaret"]))
    assert not same_street(("rue", ["saint"], ["marbaret"]), ("rue", [], ["marbaret"])) and same_street(("rue", [], ["grand", "marbaret"]), ("rue", [], ["marbaret", "grand"]))
    assert word_keys("ararrosa") & word_keys("arrarrosa") and readings("-", "x") == [] and readings(None, None) == [] and readings("sans domicile fixe", "x") == []


def test_same_places(spark):
    rows = [
        ("A", "12 rue du Marbaret", "Corchar"), ("B", "R. du Marbarte, 12", "CORCHAR Cedex"), ("C", "12 avenue du Marbaret", "Corchar"), ("D", "12 rue du Marbaret", "Belcha"), ("E", "12 bis rue du Marbaret", "Corchar"),
        ("F", "12 rue du Marbaret Corchar", None), ("G", None, "Corchar"), ("H", "rue du Marbaret", "Corchar"), (None, "12 rue du Marbaret", "Corchar"), ("A\t", "12 rue du Marbaret", "Corchar"), ("I", "appt 5, 12 rue du Marbaret", "Corchar"), ("J", "", ""),
        *((f"X{i}", "3 place Sole", "Corchar") for i in range(3)), ("L", "9 " + "x" * 5000 + " Street", "Y"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "client_id string, client_address string, client_city string, form string")
    got = {tuple(r) for r in same_places(df).collect()}
    place = ("A", "B", "F", "I")
    assert got == {(a, b) for a in place for b in place if a < b} | {("X0", "X1"), ("X0", "X2"), ("X1", "X2")}
    assert same_places(df.limit(0)).count() == 0
    flats = spark.createDataFrame([("A", "Flat 1, 12 Elm Road", "Y"), ("B", "Flat 2, 12 Elm Road", "Y"), ("C", "12 Elm Road", "Y")], "client_id string, client_address string, client_city string")
    assert same_places(flats).count() == 3 and same_places(flats, veto_units=True).count() == 2
