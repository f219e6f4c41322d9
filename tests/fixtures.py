"""Deliveries for the rule tests: a conforming one, and one deliberate edit for each rule."""

from __future__ import annotations

import io
import zipfile

NS = "http://www.vdi.de/schemas/vdi2770"
PARTY = '<Party Role="Responsible"><Organization OrganizationName="A" OrganizationOfficialName="A"/></Party>'
PDF = (
    b"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Count 3/Kids[]>>\nendobj\n"
    b"<x:xmpmeta xmlns:pdfaid='http://www.aiim.org/pdfa/ns/id/'><pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance></x:xmpmeta>\n"
    b"trailer\n<</Root 1 0 R>>\nstartxref\n0\n%%EOF"
)


def xml(doc_id="D1", classes=None, files=(("B.pdf", "application/pdf"),), status="Released", language="en", relations="", objects=None, pages=None, ids=None, extra=""):
    classes = classes or '<DocumentClassification ClassificationSystem="VDI2770:2018"><ClassId>03-02</ClassId><ClassName Language="de">Bedienung</ClassName></DocumentClassification>'
    objects = objects or '<ObjectId ObjectType="Type" RefType="article number">T1</ObjectId>'
    named = "".join(f'<DigitalFile FileFormat="{f}">{n}</DigitalFile>' for n, f in files)
    number = f' NumberOfPages="{pages}"' if pages else ""
    ids = ids or f'<DocumentId DomainId="dom">{doc_id}</DocumentId>'
    return (
        f'<?xml version="1.0" encoding="utf-8"?>\n<Document xmlns="{NS}">{ids}\n'
        f'<DocumentIdDomain DocumentDomainId="dom">{PARTY}</DocumentIdDomain>\n{classes}\n'
        f'<ReferencedObject>{objects}<Party Role="Manufacturer"><Organization OrganizationName="A" OrganizationOfficialName="A"/></Party></ReferencedObject>\n'
        f"<DocumentVersion{number}><DocumentVersionId>1</DocumentVersionId><Language>{language}</Language>{PARTY.replace('Responsible', 'Author')}\n"
        '<DocumentDescription Language="en"><Title>T</Title><Summary>S</Summary><KeyWords><KeyWord>k</KeyWord></KeyWords></DocumentDescription>\n'
        f'<LifeCycleStatus StatusValue="{status}">{PARTY}</LifeCycleStatus>\n{relations}\n{named}</DocumentVersion>{extra}</Document>'
    ).encode()


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items() if isinstance(files, dict) else files:
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def document(**changes):
    return {"VDI2770_Metadata.xml": xml(**changes), "B.pdf": PDF}


def main(inner=None, **changes):
    refers = '<DocumentRelationship Type="RefersTo"><DocumentId DomainId="dom">D1</DocumentId></DocumentRelationship>'
    kept = {"doc_id": "M", "files": (("VDI2770_Main.pdf", "application/pdf"),), "relations": refers} | changes
    return {"VDI2770_Main.xml": xml(**kept), "VDI2770_Main.pdf": PDF, "doc.zip": zipped(inner or document())}


def corrupted(files, name):
    data = bytearray(zipped(files, zipfile.ZIP_STORED))
    at = next(i for i in range(30, len(data)) if data[i - 30 : i - 26] == b"PK\x03\x04" and data[i : i + len(name)] == name.encode())
    data[at + len(name) + 8] ^= 0xFF
    return bytes(data)


def _class(cid, *names):
    inner = "".join(f'<ClassName Language="{lang}">{t}</ClassName>' for lang, t in names)
    return f'<DocumentClassification ClassificationSystem="VDI2770:2018"><ClassId>{cid}</ClassId>{inner}</DocumentClassification>'


def without(files, name):
    return {k: v for k, v in files.items() if k != name}


def nested(levels):
    inner = zipped(document())
    for k in range(levels):
        inner = zipped({**without(main(doc_id=f"M{k}"), "doc.zip"), "doc.zip": inner})
    return inner


OTHER_REL = '<DocumentRelationship Type="RefersTo"><DocumentId DomainId="dom">{}</DocumentId></DocumentRelationship>'
TWO_KINDS = '<ObjectId ObjectType="Type">X1</ObjectId><ObjectId ObjectType="Individual" RefType="serial">x1</ObjectId>'
LOCKED = PDF.replace(b"<</Root 1 0 R>>", b"<</Root 1 0 R/Encrypt 9 0 R>>")

#: rule -> a delivery that breaks it by one edit of a conforming one
BROKEN = {
    "Z1": b"no archive", "Z2": zipped({}), "Z3": zipped({"vdi2770_metadata.xml": xml(), "B.pdf": PDF}), "Z4": zipped({**document(), "../out.txt": b"x"}),
    "Z5": zipped({**document(), "zeros.bin": bytes(16 << 20)}), "Z6": nested(3), "Z7": zipped(without(main(files=(("A.pdf", "application/pdf"),)), "VDI2770_Main.pdf")),
    "Z8": zipped(without(main(relations=""), "doc.zip")), "Z9": zipped({**document(), "sub/x.txt": b"x"}), "Z10": zipped({**document(), "b.PDF": PDF}),
    "Z11": zipped({**document(), "in.zip": zipped(document())}), "Z12": corrupted(document(), "B.pdf"), "Z13": zipped([("VDI2770_Metadata.xml", xml()), ("B.pdf", PDF), ("sub/VDI2770_Metadata.xml", b"")][:2] + [("s/VDI2770_Metadata.xml", xml()), ("s/VDI2770_Metadata.xml", xml())]),
    "Z14": zipped({**document(files=(("B.pdf", "application/pdf"), ("data.zip", "application/zip"))), "data.zip": zipped({"t.txt": b"x"})}),
    "F1": zipped(without(document(), "B.pdf")), "F2": zipped({**document(), "more.txt": b"x"}), "F3": zipped({**document(files=(("B.pdf", "application/pdf"), ("B.docx", "application/pdf"))), "B.docx": PDF}),
    "F4": zipped(document(files=(("B.pdf", "application/pdf"), ("", "text/plain")))), "M1": zipped(document(classes=_class("03-02").replace("VDI2770:2018", "other"))),
    "M2": zipped(document(classes=_class("99-99"))), "M3": zipped(document(classes=_class("03-02", ("de", "Ersatzteile")))), "M4": zipped(document(classes=_class("03-02", ("en", "Running")))),
    "M5": zipped(document(language="deutsch")), "M6": zipped(document(files=(("B.pdf", "text/plain"),))), "M7": zipped(main(status="InReview")),
    "M8": zipped(document(classes=_class("03-02", ("", "Bedienung")))), "M9": zipped(document(ids='<DocumentId DomainId="d">A</DocumentId>' * 2)),
    "M10": zipped(document(ids='<DocumentId DomainId="d">A</DocumentId><DocumentId DomainId="d"> </DocumentId>')), "M11": zipped(main(relations=OTHER_REL.format("nowhere"))),
    "M12": zipped(main(inner=document(relations=OTHER_REL.format("nowhere")))), "M13": zipped(document(objects=TWO_KINDS)), "P1": zipped({**document(), "B.pdf": b"text"}),
    "P2": zipped({**document(), "B.pdf": LOCKED}), "P3": zipped({**document(), "B.pdf": PDF.replace(b"pdfa/ns", b"none/ns").replace(b"pdfaid:", b"other:")}), "P4": zipped(document()),
    "P5": zipped({**document(), "B.pdf": b"%PDF-1.4 " + b"obj" * 100_002}), "P6": zipped(document(pages="7")), "X1": zipped({**document(), "VDI2770_Metadata.xml": xml()[:-20]}),
    "X2": zipped({**document(), "VDI2770_Metadata.xml": xml(extra="<More/>")}), "X3": zipped({**document(), "VDI2770_Metadata.xml": xml().replace(b"?>\n", b'?>\n<!DOCTYPE d [<!ENTITY e "x">]>\n', 1)}),
    "X4": zipped({**document(), "VDI2770_Metadata.xml": xml(extra="<More/>" + "".join('<DocumentId/>' for _ in range(2)), ids='<DocumentId/>' * 1_200)}),
    "X6": zipped({**document(), "VDI2770_Metadata.xml": xml(extra="<a>" * 1_001 + "</a>" * 1_001)}),
}
CONFORMING = {"document": zipped(document(pages="3")), "main": zipped(main())}
