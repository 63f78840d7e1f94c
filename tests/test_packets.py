import pytest

from lodestrata.sources import packets

SPACES = " ".join(f'xmlns:{p}="{u}"' for p, u in packets.NAMESPACES.items())
WRAP = lambda body: f'<?xpacket begin="﻿"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {SPACES}>{body}</rdf:RDF></x:xmpmeta>'
ATTRIBUTE = '<rdf:Description dc:title=" T " xmp:Rating="3"/>'
ELEMENT = "<rdf:Description><dc:title>T</dc:title><xmp:Rating> 3 </xmp:Rating></rdf:Description>"
LIST = "<rdf:Description><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>T</rdf:li></rdf:Alt></dc:title><xmp:Rating><rdf:Seq><rdf:li>3</rdf:li></rdf:Seq></xmp:Rating></rdf:Description>"


@pytest.mark.parametrize("body", [ATTRIBUTE, ELEMENT, LIST])
def test_three_spellings_of_a_field_are_one_value(body):
    assert packets.packet_values(WRAP(body)) == {"dc:title": ["T"], "xmp:Rating": ["3"]}


def test_values_of_all_descriptions_in_order_without_blanks_and_other_namespaces():
    body = "<rdf:Description><dc:subject><rdf:Bag><rdf:li>b</rdf:li><rdf:li> </rdf:li><rdf:li>a</rdf:li></rdf:Bag></dc:subject><dc:title/><y:title xmlns:y='other'>no</y:title></rdf:Description><rdf:Description dc:subject='c'/>"
    assert packets.packet_values(WRAP(body)) == {"dc:subject": ["b", "a", "c"]}
    with pytest.raises(ValueError, match="entities"):
        packets.packet_values('<!DOCTYPE x [<!ENTITY a "b">]>' + WRAP(ATTRIBUTE))


def test_one_broken_packet_does_not_stop_the_others(spark):
    rows = spark.createDataFrame([(1, WRAP(LIST)), (2, "<x><broken>"), (3, None), (4, " "), (5, "no markup"), (6, WRAP("<rdf:Description/>"))], "id int, packet string")
    got = {r["id"]: (r["xmp"], r["xmp_error"]) for r in packets.with_fields(rows, "packet", "id").collect()}
    assert got == {1: ({"dc:title": ["T"], "xmp:Rating": ["3"]}, None), 2: ({}, "ParseError"), 3: ({}, None), 4: ({}, None), 5: ({}, "ValueError"), 6: ({}, None)}
