"""Word lists by which names are told apart. They must be the same wherever results are compared."""

VESSEL_SLASH = ["M/V", "M/T", "F/V", "S/S"]
VESSEL_WORDS = ["M/V", "MV", "MT", "FV", "SS", "YACHT", "HMS", "USS", "RMS", "M/T", "F/V", "S/S", "TANKER", "VESSEL", "SHIP"]
VESSEL_NORMAL = {
    "M/V": "M/V", "MV": "M/V", "M.V.": "M/V", "M/T": "M/T", "MT": "M/T", "M.T.": "M/T", "F/V": "F/V", "FV": "F/V", "F.V.": "F/V", "S/S": "S/S", "SS": "S/S", "S.S.": "S/S",
    "YACHT": "YACHT", "HMS": "HMS", "USS": "USS", "RMS": "RMS", "TANKER": "TANKER", "VESSEL": "VESSEL", "SHIP": "SHIP",
}

CORPORATE = (
    "LLC LTD PLC INC CORP CO COMPANY COMPANIES SA S.A. AG BV B.V. GMBH SARL SPA S.P.A. NV N.V. OY OYJ AB AS A/S SE SRL S.R.L. "
    "LIMITED INCORPORATED CORPORATION PTY PROPRIETARY LP LLP PLLC PC PA NA FSB GMBH. GBMH KG OHG UG LTDA LTDA. CIA CIA. SAS SASU "
    "JSC OJSC CJSC PJSC OAO ZAO PAO AO TOO OOO KK GK YK"
).split()
GOVERNMENT = (
    "MINISTRY DEPARTMENT BUREAU AGENCY AUTHORITY GOVERNMENT GOVT GOV FEDERAL STATE NATIONAL REPUBLIC KINGDOM EMBASSY CONSULATE COMMISSION "
    "COMMITTEE COUNCIL ADMINISTRATION DIRECTORATE SECRETARIAT OFFICE SERVICE FORCE MILITARY ARMY NAVY POLICE CUSTOMS TREASURY"
).split()
BANKS = ["CENTRAL BANK", "RESERVE BANK", "PEOPLES BANK"]
LOGISTICS = (
    "LOGISTICS FREIGHT SHIPPING TRANSPORT TRANSPORTATION CARGO LINES LINE PORT TERMINAL MARITIME FORWARDING FORWARDERS EXPRESS COURIER "
    "DELIVERY WAREHOUSE WAREHOUSING DISTRIBUTION CONTAINER CONTAINERS TRUCKING HAULAGE CARRIER AIRLINES AIRWAYS AVIATION"
).split()
LOGISTICS_PHRASES = ["SUPPLY CHAIN", "AIR CARGO"]
INSURANCE = "INSURANCE ASSURANCE REINSURANCE UNDERWRITING UNDERWRITERS BROKER BROKERS BROKERAGE INDEMNITY MUTUAL SYNDICATE SYNDICATION".split()
INSURANCE_MORE = "ACTUARIAL CLAIMS ADJUSTER ADJUSTERS".split()
FINANCE = (
    "BANK BANKING BANQUE BANCA BANCO FINANCE FINANCIAL FINANCING FINANZ CAPITAL CAPITALS INVESTMENT INVESTMENTS INVESTING HOLDINGS HOLDING "
    "TRUST TRUSTS TRUSTEE FUND FUNDS ASSET ASSETS MANAGEMENT SECURITIES EQUITY EQUITIES VENTURES VENTURE PARTNERS PARTNERSHIP ASSOCIATES "
    "ADVISORS ADVISORY CREDIT LENDING LEASING FACTORING"
).split()
INDICATORS = (
    "GROUP GROUPS ENTERPRISE ENTERPRISES INDUSTRIES INDUSTRY INTERNATIONAL INTL INT'L GLOBAL WORLDWIDE WORLD TRADING TRADE TRADERS EXPORT "
    "IMPORT EXPORTS IMPORTS MANUFACTURING MANUFACTURER MANUFACTURERS MFG CONSTRUCTION ENGINEERING ENGINEERS BUILDERS SERVICES SERVICE "
    "SOLUTIONS SYSTEMS TECHNOLOGIES TECHNOLOGY PRODUCTS PRODUCTIONS PRODUCTION STUDIO STUDIOS MEDIA COMMUNICATIONS TELECOM "
    "TELECOMMUNICATIONS ENERGY OIL GAS PETROLEUM PETROL MINING MINERALS PHARMACEUTICALS PHARMA HEALTHCARE MEDICAL BIOTECH FOUNDATION "
    "INSTITUTE INSTITUTION UNIVERSITY COLLEGE ASSOCIATION SOCIETY FEDERATION UNION COOPERATIVE FACTORY PLANT MILL REFINERY WORKS"
).split()
TITLES = (
    "MR MRS MS MISS DR PROF PROFESSOR SIR DAME LORD LADY REV REVEREND HON HONORABLE HONOURABLE CAPT CAPTAIN COL COLONEL GEN GENERAL MAJ "
    "MAJOR LT LIEUTENANT SGT SERGEANT CPL CORPORAL PVT PRIVATE ADM ADMIRAL CDR COMMANDER"
).split()
SUFFIXES = "JR SR II III IV V PHD PH.D MD M.D DDS D.D.S ESQ CPA C.P.A MBA M.B.A JD J.D RN R.N NP N.P PA P.A DO D.O".split()
PATRONYMICS = "OVICH EVICH OVNA EVNA ICHNA INICHNA OVIC EVIC OWICZ EWICZ".split()
PLACEHOLDERS = ["n/a", "na", "none", "null", "unknown", "tbd", "test", "xxx", "zzz", "aaa", "abc", "123", "sample", "example", "delete", "remove", "blank", "empty", "no name", "noname"]
DASHES = ["-", "--", "---", ".", "..", "..."]

LEGAL_SUFFIXES = (
    "LLC L.L.C. INC INC. INCORPORATED CORP CORP. CORPORATION CO CO. COMPANY COMPANIES LTD LTD. LIMITED LP L.P. LLP L.L.P. PLLC P.L.L.C. "
    "PC P.C. PA P.A. NA N.A. FSB F.S.B. PLC P.L.C. GMBH GMBH. AG A.G. KG K.G. OHG UG SA S.A. SARL S.A.R.L. SAS S.A.S. SASU SL S.L. SRL "
    "S.R.L. LTDA LTDA. CIA CIA. SPA S.P.A. NV N.V. BV B.V. AB A.B. AS A.S. A/S OY OYJ ASA SE S.E. PTY PROPRIETARY OAO ZAO PAO OOO AO TOO "
    "JSC OJSC CJSC PJSC KK GK YK PTE PTE. SDN SDN. BHD BHD."
).split()
LEGAL_SHORT = {"INCORPORATED": "INC", "CORPORATION": "CORP", "COMPANY": "CO", "COMPANIES": "CO", "LIMITED": "LTD"}

NAME_TITLES = "mr mrs ms miss dr prof professor sir dame lord lady rev reverend hon honorable capt captain col colonel gen general maj major lt lieutenant sgt sergeant cpl corporal pvt private".split()
NAME_SUFFIXES = "jr sr ii iii iv phd md dds esq cpa mba jd rn np pa do dvm od".split()
NAME_PATRONYMICS = "ovich evich ich ovna evna ichna inichna ovic evic owicz ewicz".split()
SLAVIC_SURNAMES = "ov ev in yn ko uk yk ak ek ik sky ski skiy skyi ckiy cki ova eva ina yna skaya skya ska cka ckaya wicz icz shvili dze adze yan ian ants".split()
MATCH_TITLES = (
    "mr mrs ms miss dr prof professor sir dame lord lady rev reverend hon honorable judge justice gen general col colonel maj major capt "
    "captain lt lieutenant sgt sergeant cpl corporal pvt private adm admiral cmdr commander"
).split()
MATCH_SUFFIXES = "jr sr i ii iii iv v phd md dds esq cpa jd llm mba msc bsc ba ma".split()
