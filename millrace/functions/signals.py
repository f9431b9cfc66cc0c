"""Names of signals, lots and contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: raw CSV header -> column, type
CONTEXT_COLUMNS = [("Processed Time", "processed_time", "timestamp"), ("Lot", "lot", "string"), ("Recipe", "recipe", "string"), ("Stage", "stage", "string"), ("Wafer No.", "wafer_no", "string"), ("System Label", "system_label", "string"), ("Recipe_Step_Num", "recipe_step_num", "int")]
MAX_STEP = ("Recipe_Max_Step", "recipe_max_step", "int")

# fixed values: the sensor signals of a trace
SIGNALS = """
APC_Close_Check APC_Mode_Set APC_Open_Check APC_Position APC_Pressure APC_SetPoint APC_Status APC_Valve_Control
ATM_Sensor Bara_Protect_Valve Chamber_Open_Intlk Chamber_Pressure DNB1_Fan_Status ELT_Box_Fan_Status ELT_Box_Intlk
EPD_Amp_Monitor1 EPD_Amp_Monitor2 EPD_Monitor1 EPD_Monitor2 Fast_Vent_Valve Gas1_Monitor Gas1_Pressure Gas1_Purge_Valve
Gas1_Set Gas1_Set_Offset Gas1_Temp Gas1_Valve Gas1_Volt Gas2_Monitor Gas2_Pressure Gas2_Purge_Valve Gas2_Set
Gas2_Set_Offset Gas2_Temp Gas2_Valve Gas2_Volt Gas3_Monitor Gas3_Pressure Gas3_Set Gas3_Set_Offset Gas3_Temp Gas3_Valve
Gas3_Volt Gas4_Monitor Gas4_Pressure Gas4_Set Gas4_Set_Offset Gas4_Temp Gas4_Valve Gas4_Volt Gas5_Monitor Gas5_Pressure
Gas5_Set Gas5_Set_Offset Gas5_Temp Gas5_Valve Gas5_Volt Gas_Box_Door_Intlk Gas_Exhaust_Alarm Gen_Rack_Door_SW
Gen_Rack_Water_Leak Gen_Water_Flow_SW H2_Leak_Alarm Heater_OnOff Heater_OverHeat Mat_Alarm Mat_Auto_Manual Mat_Irms
Mat_Mode Mat_Phase Mat_Preset Mat_Preset_Go Mat_RFOn Mat_Tuned Mat_VC1_Position Mat_VC1_Preset Mat_VC2_Position
Mat_VC2_Preset Mat_VDC Mat_VPP Mat_Vrms N2_Purge_Gas_Valve Pin_Displacement Pin_Init_Status Pin_Origin Pin_Origin_Status
Pin_Point_Control Pin_Position Pin_Position_Control Pin_Run_Status Pin_Servo_Control Pin_Servo_Status Pin_Speed_Control
Pressure SOURCE_ON_TIME Slow_Vac_Valve SourcePwr_ON SourcePwr_RESET SourcePwr_Read SourcePwr_Reflect SourcePwr_Set1
SourcePwr_SetWatt SourcePwr_Sts1 SourcePwr_Sts2 SourcePwr_Sts3 Source_Box_Fan_Sts Temp Temp_Set VacLine_HT_ON VacLine_Set
Wall_Limit_Temp Wall_Over_Temp Wall_Temp_Ctrl Wall_Temp_Monitor Wall_Temp_Set Water_Flow_Out_Cda1 Water_Flow_Out_Cda2
Water_Flow_Temp_Mon1 Water_Flow_Temp_Mon2
""".split()

# fixed values: subsystem -> (prefixes, whole names), tried in this order; all others are "interlock"
SUBSYSTEMS = {
    "apc": (["APC_"], []),
    "epd": (["EPD_"], []),
    "rf_match": (["Mat_"], []),
    "pin": (["Pin_"], []),
    "rf_source": (["SourcePwr", "Source_"], ["SOURCE_ON_TIME"]),
    "gas": (["Gas"], ["N2_Purge_Gas_Valve"]),
    "cooling": (["Water_Flow"], ["Gen_Water_Flow_SW", "Gen_Rack_Water_Leak"]),
    "thermal": (["Wall_", "Heater_", "VacLine"], ["Temp", "Temp_Set"]),
    "vacuum": (["Chamber_"], ["Pressure", "ATM_Sensor", "Bara_Protect_Valve", "Fast_Vent_Valve", "Slow_Vac_Valve"]),
}
# fixed values: parts of names of analog signals
ANALOG_PARTS = ["Position", "Pressure", "Temp", "VDC", "VPP", "Vrms", "Irms", "Phase", "Read", "Reflect", "Monitor", "Displacement", "SetPoint", "Volt", "SetWatt", "ON_TIME", "Limit_Temp", "Set1", "Preset"]
# fixed values: wafer type -> pattern over the lot name, first match counts
WAFER_TYPES = {"aging": "(?i)aging|age", "bare": "(?i)bare|dummy|dmy", "monitor": "(?i)mon|test|ted|qual|qc"}
# fixed values: signals of the risk scan and of multivariate monitoring
KEY_SIGNALS = ["APC_Position", "APC_Pressure", "SourcePwr_Read", "Mat_VDC"]
FDC_SIGNALS = ["APC_Pressure", "APC_Position", "Gas1_Monitor", "Gas2_Monitor", "SourcePwr_Read", "SourcePwr_Reflect", "Mat_VPP", "Mat_VDC", "Wall_Temp_Monitor"]
# fixed values: suffixes by which a measured signal's setpoint is named
SETPOINT_SUFFIXES = [("_Monitor", "_Set"), ("_Read", "_Set"), ("_Monitor", "_SetPoint"), ("", "_Set")]


def subsystem(signal: Column) -> Column:
    out = F
    for name, (prefixes, names) in SUBSYSTEMS.items():
        test = F.lit(False)
        for p in prefixes:
            test = test | signal.startswith(p)
        out = out.when(test | signal.isin(names), name)
    return out.otherwise("interlock")


def looks_analog(signal: Column) -> Column:
    return signal.rlike("|".join(ANALOG_PARTS))


def wafer_type(lot: Column) -> Column:
    out = F
    for name, pattern in WAFER_TYPES.items():
        out = out.when(lot.rlike(pattern), name)
    return out.otherwise("product")


def context_key(recipe: Column, stage: Column, step: Column, kind: Column | None = None) -> Column:
    return F.concat_ws("|", recipe, stage, step.cast("string"), *([kind] if kind is not None else []))


def setpoint_of(signal: str, signals: list[str] | None = None) -> str | None:
    """The signal that holds the setpoint of ``signal``, if there is one."""
    known = set(SIGNALS if signals is None else signals)
    for old, new in SETPOINT_SUFFIXES:
        guess = signal.replace(old, new, 1) if old else signal + new
        if guess != signal and guess in known:
            return guess
    return None


def assert_known(name: str, known, what: str = "signal") -> str:
    if name not in known:
        raise ValueError(f"unknown {what}: {name}")
    return name
