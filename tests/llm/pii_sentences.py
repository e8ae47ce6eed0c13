"""Sentences written by hand, not by the generator: a text, and the spans in it that are personal data."""

SENTENCES = [
    ("Hi Tom, my new number is 415-555-0132, the old one is dead.", ["415-555-0132"]),
    ("For bookings phone (020) 7946 0018 between nine and five.", ["(020) 7946 0018"]),
    ("You can reach the clinic at 312 555 0199 after hours.", ["312 555 0199"]),
    ("Tel. 0161 496 0345, fax 0161 496 0346", ["0161 496 0345", "0161 496 0346"]),
    ("Text me on 07700 900 123 when you land.", ["07700 900 123"]),
    ("Her cell: 646.555.0178 (evenings only)", ["646.555.0178"]),
    ("Dr. Okafor, landline 01632 960 958, would like a call back.", ["01632 960 958"]),
    ("call (702) 555-0143 and ask for Maria", ["(702) 555-0143"]),
    ("Our hotline 800 555 0111 is free of charge.", ["800 555 0111"]),
    ("Emergency contact: Peter, 503-555-0166", ["503-555-0166"]),
    ("WhatsApp 917 555 0120 works best.", ["917 555 0120"]),
    ("If nobody answers, dial 206-555-0104 and leave a message.", ["206-555-0104"]),
    ("My SSN is 219-09-9999 and I was born in Ohio.", ["219-09-9999"]),
    ("Social security number 457-55-5462 appears on form 3.", ["457-55-5462"]),
    ("Applicant passport 512334987, nationality Canadian", ["512334987"]),
    ("Tax ID: 943 476 581", ["943 476 581"]),
    ("NHS 943 476 5919, registered with the Elm Street practice", ["943 476 5919"]),
    ("driving licence 884217365 expires in May", ["884217365"]),
    ("national insurance file 078-05-1120 was leaked", ["078-05-1120"]),
    ("Please wire the deposit to DE89370400440532013000 by Friday.", ["DE89370400440532013000"]),
    ("IBAN GB29 NWBK 6016 1331 9268 19", ["GB29 NWBK 6016 1331 9268 19"]),
    ("Refund to FR1420041010050500013M02606 as agreed", ["FR1420041010050500013M02606"]),
    ("my account is NL91ABNA0417164300, thanks", ["NL91ABNA0417164300"]),
    ("Bank account 4417812309 at the credit union", ["4417812309"]),
    ("send the rent to account number 00123456789", ["00123456789"]),
    ("ES9121000418450200051332 belongs to the landlord", ["ES9121000418450200051332"]),
    ("I paid with card 4539578763621486 last night", ["4539578763621486"]),
    ("Visa: 4556737586899855 exp 09/27", ["4556737586899855"]),
    ("she read out 5425233430109903 over the line", ["5425233430109903"]),
    ("numbers 4916338506082832 4539578763621486 were on the slip", ["4916338506082832", "4539578763621486"]),
    ("debit card 6011000990139424 was declined", ["6011000990139424"]),
    ("Write to jane.doe [at] example [dot] org for the slides.", ["jane.doe [at] example [dot] org"]),
    ("contact me: r.silva(at)mailbox(dot)net", ["r.silva(at)mailbox(dot)net"]),
    ("e-mail kim_lee [at] campus.edu", ["kim_lee [at] campus.edu"]),
    ("questions go to help (at) shop (dot) com", ["help (at) shop (dot) com"]),
    ("j.smith [at] corp [dot] de answers within a day", ["j.smith [at] corp [dot] de"]),
    # nothing personal
    ("Order 415-555-0132 has shipped from the depot.", []),
    ("Invoice 100200300400 is due in thirty days.", []),
    ("ISBN 9780306406157, second printing", []),
    ("Serial number 219-09-9998 is engraved under the lid.", []),
    ("Part 312 555 0198 fits all models since 2004.", []),
    ("The total was 123 456 789 units in the last quarter.", []),
    ("Build 20240117093412 failed on two machines.", []),
    ("Ticket ref 702-555-0144 was closed by the agent.", []),
    ("The tracking code 1234567890123456 does not exist.", []),
    ("Item SKU 503-555-0167 is sold out.", []),
    ("batch 943 476 582 was recalled", []),
    ("article 646.555.0179 in the catalogue", []),
    ("lot 800 555 0112 went under the hammer", []),
    ("See version 102 304 5067 for the change.", []),
    ("case 078-05-1121 is on page 12 of the docket", []),
    ("We met (at) noon. Then it rained.", []),
    ("he looked (at) her. She left", []),
    ("the value 8646308210557563 is a checksum", []),
    ("the constant 6992706490339255 appears twice", []),
    ("population 143 526 8721 by the last census", []),
    ("Firmware 010 234 5678 fixes the fan.", []),
    ("patent 506-23-4411 was granted", []),
    ("model QX12 3456 7890 is discontinued", []),
    ("units sold 202 303 4040 in spring", []),
    ("reference DE12345678901234567890 is the document number", []),
    ("row 917 555 0121 of the table is empty", []),
    ("score 457-55-5461 to nil", []),
    ("the sum 731955028846 was written on the board", []),
    ("timestamps such as 1700000000123 are in milliseconds", []),
    ("order card 206-555-0105 printed twice", []),
]
