"""Small archives written by the tests: XML in a tar in a compressed tar."""

import io
import tarfile


def tar_bytes(members: dict[str, bytes], mode: str) -> bytes:
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def taz(xml: str, xml_name: str = "CRI_1.xml") -> bytes:
    inner = tar_bytes({"notes.txt": b"x", xml_name: xml.encode()}, "w")
    return tar_bytes({"readme": b"", "inner.tar": inner}, "w:gz")


def transcript(
    body: str, number: str = "83", date: str = "Mardi-06-11-Novembre-2018", summary: str = ""
) -> str:
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<?Folio 412?>
<PublicationDANBlanc>
  <Metadonnees>
    <PublicationNumero>{number}</PublicationNumero>
    <DateParution>Mercredi-07-11-Novembre-2018</DateParution>
    <DateSeance>{date}</DateSeance>
    <SessionNom>de rentrée</SessionNom>
    <SessionParlementaire>2018-2019</SessionParlementaire>
    <NumeroPremierePage>5120</NumeroPremierePage>
    <LegislatureNumero>15</LegislatureNumero>
    <Signataire><Titre>La cheffe de service</Titre><Prenom>A</Prenom><Nom>Z</Nom></Signataire>
  </Metadonnees>
  <ContenuDANBlanc><CompteRendu>
    <Metadonnees><dateSeance>2018-11-06</dateSeance></Metadonnees>
    <Contenu>
      <Quantiemes><Journee>Séance du matin</Journee><Session>Session de rentrée</Session></Quantiemes>
      {summary}
      <PresidentSeance idsyceron="1">Présidence de Mme Q</PresidentSeance>
      {body}
    </Contenu>
  </CompteRendu></ContenuDANBlanc>
</PublicationDANBlanc>"""


def write(root, year: int, number: int, content: bytes):
    folder = root / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"AN_{year}{number:03d}.taz"
    path.write_bytes(content)
    return path
